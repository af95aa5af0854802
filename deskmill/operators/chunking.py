"""Splitting texts into overlapping, section-aware chunks, as one fold over the blocks of a text in Spark SQL.

Blocks (parted by blank lines) are joined while they fit; a full buffer is put out and its tail begins the next one,
under the section of the block that comes then.  A block over the size is cut on its own and leaves no tail.  Lengths
are code points.

Cases: a null, empty or blank text has no chunk; a heading is a block of one line; repeated rows are split each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLANK = r"' \t\n\r\0\u000B'"
_HEADING = r"'(?dU)^#{1,6}\\s+(.+?)\\s*$'"
_CHUNK = "struct<section: string, content: string>"


def _fold(items: str, state: str, start: dict[str, str], item: str, step: dict[str, str], out: str, of: str, end: str) -> str:
    """SQL of a fold that puts out a list: ``step`` are the next fields of the state, ``out`` its next list, ``end`` what ends it.

    Spark copies a state at each step, so n items are folded in about sqrt(n) parts, whose lists are gathered by a fold over
    the parts.
    """
    def fields(of: dict[str, str]) -> str:
        return "".join(f"'{k}', {v}, " for k, v in of.items())

    root = f"greatest(1, cast(ceil(sqrt(size({item}s))) AS int))"
    parts = f"transform(sequence(0, greatest(size({item}s) - 1, 0), {root}), at -> slice({item}s, at + 1, {root}))"
    part = f"""aggregate(part, named_struct({fields({k: f'{state}s.{k}' for k in start})}'out', cast(array() AS array<{of}>)),
 ({state}, {item}) -> named_struct({fields(step)}'out', {out}),
 {state} -> named_struct({fields({k: f'{state}.{k}' for k in start})}'out', concat({state}s.out, array({state}.out))))"""
    whole = f"""aggregate({parts}, named_struct({fields(start)}'out', cast(array() AS array<array<{of}>>)),
 ({state}s, part) -> {part}, {state} -> concat(flatten({state}.out), {end}))"""
    return f"transform(array({items}), {item}s -> {whole})[0]"


def _cut(block: str, size: str, overlap: str) -> str:
    """Windows of a long block, ended after the last space of their second half if there is one.

    The block comes in pieces no longer than the least step of a window, so a window at most is complete before each piece.
    """
    pieces = f"concat(regexp_extract_all({block}, concat('(?s).{{1,', {size} div 2 + 2 - {overlap}, '}}'), 0), array(''))"
    space = f"{size} - length(substring_index(left(w.rest, {size}), ' ', -1)) - 1"
    till = f"transform(array({space}), sp -> if(sp > {size} / 2, sp + 1, {size}))[0]"
    full = f"length(w.rest) > {size}"
    rest = f"concat(if({full}, substring(w.rest, greatest({till} - {overlap}, 1) + 1), w.rest), piece)"
    out = f"if({full}, concat(w.out, array(left(w.rest, {till}))), w.out)"
    parts = _fold(pieces, "w", {"rest": "''"}, "piece", {"rest": rest}, out, "string", "array(w.rest)")
    return f"filter(transform({parts}, p -> btrim(p, {_BLANK})), p -> p <> '')"


def chunks_sql(text: str, size: str, overlap: str) -> str:
    """SQL of the chunks (position, section, content) of a text, all three given as SQL; plain numbers are taken as they stand.

    Size 0 or null means 1,200, 300 is the least size; a null overlap means 150, half a chunk is the most.
    """
    if not size.isdigit():
        size = f"greatest(300, coalesce(nullif({size}, 0), 1200))"
    if not overlap.isdigit():
        overlap = f"greatest(0, least(coalesce({overlap}, 150), {size} div 2))"
    blocks = f"filter(transform(split(btrim({text}, {_BLANK}), '\\\\n{{2,}}'), b -> btrim(b, {_BLANK})), b -> b <> '')"
    blocks = f"transform({blocks}, b -> named_struct('text', b, 'heading', if(b RLIKE {_HEADING}, btrim(regexp_extract(b, {_HEADING}, 1), {_BLANK}), NULL)))"
    section, held = "coalesce(b.heading, s.section)", f"btrim(s.held, {_BLANK})"
    flush = f"array(named_struct('section', s.started, 'content', {held}))"
    cut = f"transform({_cut('b.text', size, overlap)}, p -> named_struct('section', {section}, 'content', p))"
    none = f"cast(array() AS array<{_CHUNK}>)"
    tail = f"if({overlap} > 0 AND {overlap} < length({held}), concat(right({held}, {overlap}), '\\n\\n\\n\\n'), '')"
    long, full = f"length(b.text) > {size}", f"(s.held <> '' AND length(s.held) + length(b.text) + 2 > {size})"
    out = f"CASE WHEN {long} THEN concat(s.out, if(s.held <> '', {flush}, {none}), {cut}) WHEN {full} THEN concat(s.out, {flush}) ELSE s.out END"
    kept = f"CASE WHEN {long} THEN '' WHEN {full} THEN concat({tail}, b.text) WHEN s.held = '' THEN b.text ELSE concat(s.held, '\\n\\n', b.text) END"
    started = f"CASE WHEN {long} THEN CAST(NULL AS string) WHEN s.held <> '' AND NOT {full} THEN s.started ELSE {section} END"
    start = {"held": "''", "started": "CAST(NULL AS string)", "section": "CAST(NULL AS string)"}
    fold = _fold(blocks, "s", start, "b", {"held": kept, "started": started, "section": section}, out, _CHUNK, f"if(s.held <> '', {flush}, {none})")
    return f"transform({fold}, (c, i) -> named_struct('position', i, 'section', c.section, 'content', c.content))"


def limits(size: int | None, overlap: int | None) -> tuple[int, int]:
    """Size and overlap in use, as in ``chunks_sql``."""
    size = max(300, size or 1200)
    return size, max(0, min(150 if overlap is None else overlap, size // 2))


def chunk_text(df: DataFrame, text_col: str = "text", size: int = 1200, overlap: int = 150) -> DataFrame:
    """A row per chunk with position, section and content; other columns of ``df`` stay in front."""
    text, (size, overlap) = "`" + text_col.replace("`", "``") + "`", limits(size, overlap)
    return df.select(*(df[f"`{c}`"] for c in df.columns if c != text_col), F.expr(f"inline({chunks_sql(text, str(size), str(overlap))})"))
