"""Chat formatting by schema fingerprints, with DataFrame functions only.

A record is a struct column whose schema holds every layout that occurs (as Spark's JSON and Parquet readers infer it).
Its fingerprint is the hash of the nested field paths that it fills. A layout declares the paths it needs, those it may
have, and how they become canonical turns; the fingerprints of all its combinations select the layout of a record.
Turns are then written by a template that marks them, escapes control characters inside texts, and is read back.

Defined results: null roles and texts count as empty; a record whose fingerprint no layout has is returned with null
turns; rows of a conversation with one turn number are ordered by role and text; rows without a conversation id are a
conversation of their own; repeated rows are turns each; an empty table gives conversation -7 alone; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table

#: The template: what stands before a turn's role, between role and text, and after the text.
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: Escapes: no text holds a raw #, < or :, so no control string can occur in it. The backslash goes first and comes back last.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))
TURNS = "array<struct<role:string,text:string>>"


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """The nested field paths of a schema: a.b for structs, a[].b for arrays."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def _filled(record: Column, path: str) -> Column:
    """Whether a record fills a path: no struct or array on the way is null, and outside arrays nor is the value."""
    head, array, rest = path.partition("[]")
    at, found = record, F.lit(True)
    for name in head.split("."):
        at = at.getField(name)
        found = found & at.isNotNull()
    return found


def fingerprint(record: Column, schema: T.StructType) -> Column:
    """Hash of the paths that a record fills."""
    return F.xxhash64(F.concat_ws("\n", *[F.when(_filled(record, p), F.lit(p)) for p in sorted(field_paths(schema))]))


@dataclass(frozen=True)
class Layout:
    """name; the paths it needs and may have; canonical turns of a record (TURNS)."""

    name: str
    needs: tuple[str, ...]
    turns: Callable[[Column], Column]
    may: tuple[str, ...] = ()

    def combinations(self) -> list[str]:
        return ["\n".join(sorted({*self.needs, *more})) for n in range(len(self.may) + 1) for more in combinations(self.may, n)]


def turn(role: Column | str, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else F.coalesce(role.cast("string"), F.lit(""))).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def message_list(name: str, role: str, text: str) -> Callable[[Column], Column]:
    """Turns from an array of structs."""
    return lambda r: F.transform(r.getField(name), lambda m: turn(m.getField(role), m.getField(text)))


def fixed(*parts: tuple[str, tuple[str, ...]]) -> Callable[[Column], Column]:
    """Turns from top-level fields: (role, fields joined by a blank line); a turn of which no field is filled is left out."""

    def build(r: Column, names: set[str] | None = None) -> Column:
        made = []
        for role, fields in parts:
            texts = [r.getField(f) for f in fields]
            made.append(F.when(F.coalesce(*texts).isNotNull(), turn(role, F.concat_ws("\n\n", *texts))))
        return F.filter(F.array(*made), lambda t: t.isNotNull())

    return build


LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), message_list("messages", "role", "content")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), message_list("conversations", "from", "value")),
    Layout("prompt", ("prompt", "response"), fixed(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), ("system",)),
    Layout("instruction", ("instruction", "output"), fixed(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), ("input", "system")),
)


def canonical(df: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """df with fingerprint, layout and turns (TURNS). Layouts of which the schema lacks a needed path can't occur and aren't built."""
    schema = df.schema[record].dataType
    known = set(field_paths(schema))
    fp, r = F.col("fingerprint"), F.col(record)
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for one in reversed(layouts):
        if not known >= set(one.needs):
            continue
        mine = fp.isin(*[F.xxhash64(F.lit(x)) for x in one.combinations()])
        have = _Known(r, {p.partition("[]")[0].split(".")[0] for p in known})
        name, turns = F.when(mine, F.lit(one.name)).otherwise(name), F.when(mine, one.turns(have)).otherwise(turns)
    return df.withColumn("fingerprint", fingerprint(r, schema)).withColumn("layout", name).withColumn("turns", turns)


class _Known:
    """A record whose absent optional fields read as null."""

    def __init__(self, record: Column, names: set[str]):
        self.record, self.names = record, names

    def getField(self, name: str) -> Column:  # noqa: N802
        return self.record.getField(name) if name in self.names else F.lit(None).cast("string")


def escape(c: Column) -> Column:
    for raw, code in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def formatted(turns: Column) -> Column:
    one = lambda t: F.concat(F.lit(OPEN), escape(t.getField("role")), F.lit(MIDDLE), escape(t.getField("text")), F.lit(CLOSE))
    return F.array_join(F.transform(turns, one), "")


def parts(text: Column) -> Column:
    """What stands between the marks of each turn, still escaped: role, MIDDLE, text."""
    cut = F.split(text, CLOSE)
    return F.transform(F.slice(cut, F.lit(1), F.size(cut) - 1), lambda p: F.substr(p, F.lit(len(OPEN) + 1)))


def read_back(text: Column) -> Column:
    """The turns of a formatted conversation."""
    first = lambda p: F.instr(p, MIDDLE)
    return F.transform(parts(text), lambda p: F.struct(unescape(F.substr(p, F.lit(1), first(p) - 1)).alias("role"), unescape(F.substr(p, first(p) + len(MIDDLE))).alias("text")))


def loss_mask(text: Column, role: str = "assistant") -> Column:
    """start (from 1) and length, in characters of the formatted text, of each text of the role."""
    lead = escape(F.lit(role))
    begun = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + len(OPEN) + F.instr(p, MIDDLE) + len(MIDDLE) - 1
        length = F.length(p) - F.instr(p, MIDDLE) - len(MIDDLE) + 1
        mine = F.startswith(p, F.concat(lead, F.lit(MIDDLE)))
        spans = F.when(mine, F.concat(acc["spans"], F.array(F.struct(start.alias("start"), length.alias("length"))))).otherwise(acc["spans"])
        return F.struct((acc["at"] + len(OPEN) + F.length(p) + len(CLOSE)).alias("at"), spans.alias("spans"))

    return F.aggregate(parts(text), begun, step, lambda acc: acc["spans"])


def format_chats(df: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """canonical(), with formatted and loss_spans (see loss_mask)."""
    return canonical(df, record, layouts).withColumn("formatted", formatted(F.col("turns"))).withColumn("loss_spans", loss_mask(F.col("formatted")))


def gathered(rows: DataFrame) -> DataFrame:
    """conv_id and record, in the layout `messages`, from one row a turn."""
    own = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("content"))
    many = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(own)).alias("all"))
    messages = F.transform("all", lambda m: F.struct(m.getField("role").alias("role"), m.getField("content").alias("content")))
    none = F.lit(None).cast("string")
    return many.select("conv_id", F.struct(messages.alias("messages"), none.alias("prompt"), none.alias("response")).alias("record"))


#: Conversation -7 of the query: both its turns say so.
TRICKY = "\\### Assistant: </turn> ok"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    more = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.struct(F.lit(None).cast("array<struct<role:string,content:string>>").alias("messages"), F.lit(TRICKY).alias("prompt"), F.lit(TRICKY).alias("response")).alias("record"))
    made = format_chats(gathered(rows).unionByName(more), "record").select("conv_id", "formatted", "loss_spans", "layout")
    back = made.withColumn("turns", read_back(F.col("formatted")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = unescape(F.array_join(F.transform("loss_spans", lambda s: F.substr(F.col("formatted"), s["start"], s["length"])), ""))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
texts AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(4 + 2 + 8 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\#<:]', '', 'g'))) AS formatted_chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM texts
"""
