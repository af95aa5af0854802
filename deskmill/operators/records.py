"""Texts of field records, and validation of form submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskmill.functions.text import normalize_text
from deskmill.operators.conversations import EMAIL

TRUE = ("1", "true", "yes", "on")
#: File names that cameras and phones give (a fixed value).
CAMERA_NAME = r"(?i)^(img|dsc|dscn|dscf|pxl|gopr|p|photo|foto|image)?[ _-]?\d{3,}[ _-]?\w{0,8}$"
#: Fields of a value of no known kind that hold prose.
PROSE = ("description", "summary", "text")
_BLANKS = " \t\n\r\0\x0b"


def humanize(handle: str) -> str:
    """A field handle as a label: every capital but a first one begins a word, as do _ and -."""
    import re

    words = re.sub(r"(?<!^)(?=[A-Z])", " ", handle).replace("_", " ").replace("-", " ").strip()
    return words[:1].upper() + words[1:]


def _trimmed(c: Column) -> Column:
    return F.coalesce(F.btrim(c.cast("string"), F.lit(_BLANKS)), F.lit(""))


def _lines(parts: Column) -> Column:
    """One line for each part that says something; a lone 0 doesn't."""
    return F.array_join(F.filter(parts, lambda x: ~x.isin("", "0")), "\n")


def _block(label: str, value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit(label), F.when(F.contains(value, F.lit("\n")), ":\n").otherwise(": "), value)).otherwise("")


def field_text(c: Column, kind: T.DataType, labels: dict[str, str] | None = None, depth: int = 0) -> Column:
    """Searchable text of a field, by its type; empty where there is none.

    Booleans have no text, dates are days, arrays give a line per item.  A struct is an option (label, value): its label, else its
    value; an asset (alt, title): its alt text, else its title unless a camera gave it; a related record (title and fields): its title and its
    labelled fields, each once, but not what those relate to in turn; else the prose it holds.
    """
    if isinstance(kind, T.BooleanType | T.BinaryType | T.MapType | T.NullType):
        return F.lit("")
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
    if isinstance(kind, T.FloatType | T.DoubleType):
        return F.coalesce(F.regexp_replace(c.cast("string"), r"\.0$", ""), F.lit(""))
    if isinstance(kind, T.ArrayType):
        parts = F.transform(c, lambda x: field_text(x, kind.elementType, labels, depth))
        return F.coalesce(_lines(parts), F.lit(""))
    if not isinstance(kind, T.StructType):
        return F.coalesce(c.cast("string"), F.lit(""))
    names = set(kind.names)
    text = lambda name: _trimmed(c[name])
    if names == {"label", "value"}:
        return F.when(text("label") != "", text("label")).otherwise(text("value"))
    if "title" not in names:
        prose = [text(n) for n in PROSE if n in names and isinstance(kind[n].dataType, T.StringType)]
        return F.array_join(F.array_distinct(F.filter(F.array(*prose), lambda x: x != "")), "\n") if prose else F.lit("")
    if depth >= 2:
        return F.lit("")
    title, fields = text("title"), [f for f in kind.fields if f.name != "title"]
    if "alt" in names:
        title, fields = F.when(text("alt") != "", text("alt")).when(F.rlike(title, F.lit(CAMERA_NAME)), "").otherwise(title), [f for f in fields if f.name != "alt"]
    blocks = [_block((labels or {}).get(f.name) or humanize(f.name), _trimmed(field_text(c[f.name], f.dataType, labels, depth + 2))) for f in fields]
    return F.array_join(F.array_distinct(F.filter(F.array(title, *blocks), lambda x: x != "")), "\n")


def absolute_url(c: Column) -> Column:
    """The URL if it has scheme and host, else null."""
    return F.when(F.rlike(c, F.lit(r"(?i)^https?://")), c)


def header_lines(title: Column, url: Column | None, header: dict[str, str] | None = None, name: str | None = None) -> Column:
    """Lines Name, Title, URL and those of ``header`` (label to column), without blank ones."""
    lines = {"Name": F.lit(name), "Title": title, "URL": absolute_url(url) if url is not None else F.lit(None)}
    lines |= {label: F.col(c) for label, c in (header or {}).items() if label not in lines}
    return F.concat_ws("\n", *(F.when(_trimmed(c) != "", F.concat(F.lit(f"{label}: "), _trimmed(c))) for label, c in lines.items()))


def record_blocks(df: DataFrame, fields: list[str], labels: dict[str, str] | None = None, excluded: tuple[str, ...] | dict[str, tuple[str, ...]] = (), scope: str | None = None) -> list[Column]:
    """``Label: value`` per field, null where it has no value or is left out.

    ``excluded`` names fields, or maps scopes (values of column ``scope``; ``*`` is all) to the fields left out there.
    """
    by_scope = excluded if isinstance(excluded, dict) else {"*": excluded}
    blocks = []
    for f in df.select(*(F.col(f"`{c}`") for c in fields)).schema.fields:
        if f.name in by_scope.get("*", ()):
            continue
        block = _block((labels or {}).get(f.name) or humanize(f.name), _trimmed(field_text(F.col(f"`{f.name}`"), f.dataType, labels)))
        out = [s for s, names in by_scope.items() if s != "*" and f.name in names]
        blocks.append(F.when((block != "") & (~F.coalesce(F.col(scope).cast("string").isin(out), F.lit(False)) if out and scope else F.lit(True)), block))
    return blocks


def labelled_text(df: DataFrame, id: str, title: str, url: str | None, fields: list[str], labels: dict[str, str] | None = None, excluded: tuple[str, ...] | dict[str, tuple[str, ...]] = (), header: dict[str, str] | None = None, scope: str | None = None, name: str | None = None) -> DataFrame:
    """(id, text): a header of name, title, URL and ``header``, then a block ``Label: value`` per field that has a value; normalized."""
    head = header_lines(F.col(title), F.col(url) if url else None, header, name)
    text = F.concat_ws("\n\n", F.when(head != "", head), *record_blocks(df, fields, labels, excluded, scope))
    return df.select(F.col(id).alias("id"), text.alias("text")).select("id", normalize_text(F.col("text")).alias("text"))


def validate_submissions(raw: DataFrame, fields: DataFrame) -> DataFrame:
    """(id, values, missing, invalid) of submissions (id, form_name, payload JSON) by declared fields.

    ``fields`` is (form_name, name, type, required, options, value): settings, a few rows per form.
    """
    p = raw.withColumn("given", F.from_json("payload", "map<string,string>"))
    j = p.join(fields, "form_name")
    text = F.btrim(F.coalesce(F.col("given")[F.col("name")], F.lit("")), F.lit(" \t\n\r\0\x0b"))
    as_list = F.startswith(text, F.lit("["))
    parts = F.when(as_list, F.from_json(text, "array<string>")).otherwise(F.split(text, ","))
    parts = F.array_distinct(F.filter(F.transform(parts, lambda x: F.btrim(x)), lambda x: x != ""))
    kind, boxes = F.col("type"), F.col("type") == "checkboxes"
    granted = F.lower(text).isin(*TRUE)
    unknown = F.size(F.array_except(parts, F.coalesce("options", F.array().cast("array<string>")))) > 0
    blank = F.when(boxes, F.size(parts) == 0).when(kind == "consent", ~granted).otherwise(text == "")
    state = (
        F.when(kind == "hidden", "ok")
        .when(as_list & ~boxes, "invalid")
        .when(blank, F.when(F.col("required"), "missing").otherwise("skip"))
        .when(boxes & unknown, "invalid")
        .when((kind == "select") & ~F.coalesce(F.array_contains("options", text), F.lit(False)), "invalid")
        .when((kind == "email") & ~F.rlike(text, F.lit(EMAIL)), "invalid")
        .when((kind == "number") & F.try_to_number(text, F.lit("S999999999999.999999")).isNull() & ~F.rlike(text, F.lit(r"^[+-]?[0-9]+(\.[0-9]+)?$")), "invalid")
        .otherwise("ok")
    )
    value = F.when(kind == "hidden", F.col("value")).when(kind == "consent", F.lit("Yes")).when(boxes, F.array_join(parts, ", ")).otherwise(text)
    j = j.select("id", "name", state.alias("state"), value.alias("v"))
    names = lambda s: F.sort_array(F.collect_list(F.when(F.col("state") == s, F.col("name"))))
    return j.groupBy("id").agg(F.map_from_entries(F.collect_list(F.when(F.col("state") == "ok", F.struct("name", "v")))).alias("values"), names("missing").alias("missing"), names("invalid").alias("invalid"))
