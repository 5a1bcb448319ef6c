"""Chat formatting by schema fingerprints, in columns only.

Prompt, instruction and message layouts meet in one table whose schema is the union of theirs, as ``spark.read.json`` gives it. A row's
*fingerprint* is a hash of the sorted paths of the nested fields that it fills. Layouts are declared as mappings (which path is which
role's text, or which list holds messages, what its roles are called); each mapping lists the fingerprints it stands for, one per choice
of its optional fields, and the fingerprint alone selects the mapping that turns a row into canonical turns.

The template marks turns as ``<s>[role]\\n`` ... ``</s>``. Inside roles and texts the characters that marks are made of are escaped
reversibly, ``\\`` as ``\\e``, ``<`` as ``\\l``, ``[`` as ``\\b`` and ``]`` as ``\\c``, so no text can contain a mark. The loss mask is a list of
(start, end) code point spans of the formatted text, one per assistant text.

Defined results: null text or role is empty; a row that fills no known layout keeps its id, with layout null and no turns; an empty list
of messages gives no turns; rows of equal id and turn follow each other by role and text; an empty table gives an empty result; columns
that no layout mentions are no part of the fingerprint and are dropped. Texts may be of any length; a conversation of n turns costs n, and a little of n * n / BLOCK.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tributary.tables import keep

ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("]", "\\c"))
OPEN, CLOSE = "<s>[", "</s>"
#: Turns, or spans, that are added up or cut out together.
BLOCK = 256
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Fields:
    """A layout whose turns stand in fields: (role, path) in order of the turns. Optional ones may be absent."""

    name: str
    turns: tuple[tuple[str, str], ...]
    optional: tuple[str, ...] = ()

    def paths(self) -> list[frozenset[str]]:
        fixed = [p for _, p in self.turns if p not in self.optional]
        some = chain.from_iterable(combinations(self.optional, n) for n in range(len(self.optional) + 1))
        return [frozenset([*fixed, *s]) for s in some]

    def apply(self) -> Column:
        turns = [F.when(F.col(p).isNotNull(), F.struct(F.lit(r).alias("role"), F.col(p).alias("text"))) for r, p in self.turns]
        return F.filter(F.array(*turns), lambda x: x.isNotNull())


@dataclass(frozen=True)
class Messages:
    """A layout whose turns stand in a list of structs."""

    name: str
    path: str
    role: str
    text: str
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[frozenset[str]]:
        return [frozenset(f"{self.path}[].{x}" for x in some) for some in ((self.role, self.text), (self.text,), (self.role,))] + [frozenset([self.path])]

    def apply(self) -> Column:
        def turn(x: Column) -> Column:
            role = reduce(lambda c, pair: F.when(x[self.role] == pair[0], F.lit(pair[1])).otherwise(c), self.roles, x[self.role])
            return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(x[self.text], F.lit("")).alias("text"))

        return F.transform(F.col(self.path), turn)


LAYOUTS = (
    Fields("prompt", (("system", "system"), ("user", "prompt"), ("assistant", "completion")), ("system", "completion")),
    Fields("instruction", (("user", "task.instruction"), ("assistant", "task.output")), ("task.output",)),
    Messages("messages", "messages", "role", "content"),
    Messages("conversations", "conversations", "from", "value", (("human", "user"), ("gpt", "assistant"))),
)
#: The union of the layouts, as a table of mixed records has it.
UNION = (
    "system string, prompt string, completion string, task struct<instruction:string,output:string>, "
    "messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>"
)


def _has(name: str):
    return lambda x: x[name].isNotNull()


def filled_paths(schema: T.StructType, prefix: str = "") -> list[Column]:
    """A column per nested field: its path where a row fills it, else null. Of a list, the fields that any element fills."""
    found = []
    for field in schema.fields:
        path = f"{prefix}{field.name}"
        if isinstance(field.dataType, T.StructType):
            found += filled_paths(field.dataType, f"{path}.")
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StructType):
            names = field.dataType.elementType.fieldNames()
            found += [F.when(F.exists(F.col(path), _has(n)), F.lit(f"{path}[].{n}")) for n in names]
            bare = ~F.exists(F.col(path), lambda x: reduce(lambda a, b: a | b, [x[n].isNotNull() for n in names]))
            found.append(F.when(F.col(path).isNotNull() & bare, F.lit(path)))
        else:
            found.append(F.when(F.col(path).isNotNull(), F.lit(path)))
    return found


def fingerprint(schema: T.StructType) -> Column:
    return F.sha2(F.array_join(F.sort_array(F.array_compact(F.array(*filled_paths(schema)))), "\n"), 256)


def canonical_turns(records: DataFrame, layouts: Sequence[Fields | Messages] = LAYOUTS, keys: Sequence[str] = ("conv_id",)) -> DataFrame:
    """(keys, fingerprint, layout, turns) of records in mixed layouts."""
    used = {x.path.split(".")[0] for x in layouts if isinstance(x, Messages)} | {p.split(".")[0] for x in layouts if isinstance(x, Fields) for _, p in x.turns}
    schema = T.StructType([f for f in records.schema.fields if f.name in used])
    df = records.withColumn("fingerprint", fingerprint(schema))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in reversed(layouts):
        stands_for = F.col("fingerprint").isin(*[_hash(p) for p in layout.paths()])
        name = F.when(stands_for, F.lit(layout.name)).otherwise(name)
        turns = F.when(stands_for, layout.apply().cast(TURNS)).otherwise(turns)
    return df.select(*keys, "fingerprint", name.alias("layout"), F.coalesce(turns, F.array().cast(TURNS)).alias("turns"))


def _hash(paths: frozenset[str]) -> str:
    import hashlib

    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def escape(text: Column) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[1]), F.lit(pair[0])), reversed(ESCAPES), text)


def format_turns(df: DataFrame, turns: str = "turns") -> DataFrame:
    """``df`` with ``formatted`` and ``loss_mask`` in place of its turns."""
    others = [c for c in df.columns if c not in (turns, "formatted", "loss_mask")]
    head = lambda x: F.concat(F.lit(OPEN), escape(F.coalesce(x["role"], F.lit(""))), F.lit("]\n"))
    pieces = F.transform(turns, lambda x: F.struct(head(x).alias("head"), escape(F.coalesce(x["text"], F.lit(""))).alias("body"), (x["role"] == "assistant").alias("loss")))
    df = df.select(*others, pieces.alias("_pieces"))
    whole = F.array_join(F.transform("_pieces", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "")
    # the end of every turn so far, added up in blocks of turns: a list that grows is copied with each turn, so none grows long
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def add(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["head"])
        end = begin + F.length(x["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + len(CLOSE)).alias("at"), F.when(x["loss"], F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    blocks = F.transform(_blocks(F.size("_pieces")), lambda i: F.aggregate(F.slice("_pieces", i, F.lit(BLOCK)), start, add))
    df = df.select(*others, whole.alias("formatted"), blocks.alias("_blocks"))
    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    begins = F.aggregate("_blocks", first, lambda a, b: F.struct((a["at"] + b["at"]).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")), lambda a: a["starts"])
    df = df.select(*others, "formatted", "_blocks", begins.alias("_begins"))
    moved = lambda b, at: F.transform(b["spans"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end")))
    return df.select(*others, "formatted", F.flatten(F.zip_with("_blocks", "_begins", moved)).alias("loss_mask"))


def _blocks(n: Column) -> Column:
    """The places (from 1) at which blocks of BLOCK among ``n`` elements start."""
    return F.when(n > 0, F.sequence(F.lit(1), n, F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))


def read_back(df: DataFrame) -> DataFrame:
    """``df`` with ``turns`` parsed from ``formatted`` and ``loss_text`` cut out by ``loss_mask``."""
    pieces = F.filter(F.split("formatted", CLOSE), lambda x: x != "")
    body = lambda x: F.substr(x, F.lit(len(OPEN) + 1))
    head = lambda x: F.substring_index(body(x), "]\n", 1)
    turn = lambda x: F.struct(unescape(head(x)).alias("role"), unescape(F.substr(body(x), F.length(head(x)) + 3)).alias("text"))
    cut = lambda t, s, at: F.substr(t, (s["start"] - at + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    # a place in a text is found by counting from its start: blocks of spans are cut out first, spans from these

    def block(i: Column) -> Column:
        spans = F.slice("loss_mask", i, F.lit(BLOCK))
        begin = F.get(spans, F.lit(0))["start"]
        whole = F.struct(begin.alias("start"), F.element_at(spans, -1)["end"].alias("end"))
        return F.struct(cut(F.col("formatted"), whole, F.lit(0)).alias("t"), begin.alias("at"), spans.alias("spans"))

    blocks = F.transform(_blocks(F.size("loss_mask")), block)
    texts = F.transform(blocks, lambda b: F.array_join(F.transform(b["spans"], lambda s: unescape(cut(b["t"], s, b["at"]))), ""))
    return df.withColumn("turns", F.transform(pieces, turn)).withColumn("loss_text", F.array_join(texts, ""))


def digests(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """Per stored conversation: what is read back from its formatted text and its mask."""
    df = read_back(formatted)
    joined = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return df.select(
        key,
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        *[c for c in ("layouts",) if c in df.columns],
    )


def as_records(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as records of the layouts that their sources would use: every two turns of a conversation are a
    prompt, an instruction or a list of messages, by what they are. (conv_id, part, fields of UNION)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parts = rows.repartition("conv_id").groupBy("conv_id", F.floor(F.col("turn") / 2).cast("bigint").alias("part")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    is_ = lambda *names: roles == F.array(*map(F.lit, names))
    text = lambda i: F.get("t", F.lit(i))["text"]
    odd = F.coalesce(F.pmod(F.col("part"), F.lit(2)) == 1, F.lit(False))
    prompt, system, task = is_("user", "assistant") & ~odd, is_("system", "user"), is_("user", "assistant") & odd
    alone = is_("user")
    listed = ~(prompt | system | task | alone)
    # roles that the conversations layout would rename are listed as messages
    named = odd & ~F.exists(roles, lambda r: r.isin("human", "gpt"))
    return parts.select(
        "conv_id",
        "part",
        F.when(system, text(0)).alias("system"),
        F.when(prompt | alone, text(0)).when(system, text(1)).alias("prompt"),
        F.when(prompt, text(1)).alias("completion"),
        F.when(task, F.struct(text(0).alias("instruction"), text(1).alias("output"))).alias("task"),
        F.when(listed & ~named, F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))).alias("messages"),
        F.when(listed & named, F.transform("t", lambda x: F.struct(F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"]).alias("from"), x["text"].alias("value")))).alias("conversations"),
    )


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, layouts, turns) from canonical turns of parts: a conversation is one formatted text, so its turns meet in one row."""
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "layout", "turns"))).alias("p"))
    layouts = F.array_join(F.array_distinct(F.transform("p", lambda x: F.coalesce(x["layout"], F.lit("unknown")))), ",")
    return whole.select("conv_id", layouts.alias("layouts"), F.flatten(F.transform("p", lambda x: x["turns"])).alias("turns"))


CONTROL = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    ids = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"))
    planted = ids.withColumn("role", F.when(F.col("turn") == 0, "user").otherwise("assistant")).withColumn("text", F.lit(CONTROL))
    records = as_records(given.unionByName(planted))
    formatted = keep(format_turns(conversations(canonical_turns(records, keys=("conv_id", "part")))))
    return digests(formatted)


ORACLE = rf"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}')),
c AS (SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    CAST(sum({len(OPEN) + 2 + len(CLOSE)} + length(role || text) + length(regexp_replace(role || text, '[^\\<\[\]]', '', 'g'))) AS BIGINT) AS formatted_chars
  FROM rows GROUP BY conv_id),
l AS (SELECT conv_id, CAST(turn // 2 AS BIGINT) AS part, list(role ORDER BY turn, role, text) AS roles FROM rows GROUP BY 1, 2),
m AS (SELECT conv_id, part, CASE WHEN roles = ['user', 'assistant'] THEN CASE WHEN part % 2 = 0 THEN 'prompt' ELSE 'instruction' END
    WHEN roles = ['system', 'user'] OR roles = ['user'] THEN 'prompt' WHEN part % 2 = 0 OR list_has_any(roles, ['human', 'gpt']) THEN 'messages' ELSE 'conversations' END AS layout FROM l),
n AS (SELECT conv_id, layout, min(part) AS part FROM m GROUP BY 1, 2)
SELECT c.conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
  (SELECT string_agg(layout, ',' ORDER BY part) FROM n WHERE n.conv_id = c.conv_id) AS layouts FROM c
"""
