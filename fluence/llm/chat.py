"""Chat formatting with DataFrame functions only.

A record, a struct or a JSON text, is fingerprinted by hashing its nested field paths; the fingerprint selects a declarative mapping (two
paths and two roles, or an array of turns) into canonical turns. Turns are written with a template; control strings inside
texts are escaped so that they can be restored; the loss mask covers each assistant text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

TURNS = "array<struct<role:string,text:string>>"

# Layouts by their field paths (sorted; [] is an array), and how each gives turns. A mapping is a list of
# (role, path) pairs, or the path of an array with the names of its role and text fields.
LAYOUTS: dict[tuple[str, ...], list[tuple[str, str]] | tuple[str, str, str]] = {
    ("messages[].content", "messages[].role"): ("messages", "role", "content"),
    ("conversations[].from", "conversations[].value"): ("conversations", "from", "value"),
    ("completion", "prompt"): [("user", "prompt"), ("assistant", "completion")],
    ("prompt", "response"): [("user", "prompt"), ("assistant", "response")],
    ("answer", "question"): [("user", "question"), ("assistant", "answer")],
    ("instruction", "output"): [("user", "instruction"), ("assistant", "output")],
    ("input", "instruction", "output"): [("system", "instruction"), ("user", "input"), ("assistant", "output")],
    ("data.prompt", "data.reply", "data.system"): [("system", "data.system"), ("user", "data.prompt"), ("assistant", "data.reply")],
}
#: Bytes of a JSON record below which Spark's parser meets none of its limits (20 million characters of a text, 128 MiB of a variant).
JSON_BYTES = 16_000_000
# Other names of roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

# The template's marks, and what escapes write for characters that marks and common control strings need.
BEGIN, AFTER_ROLE, FINISH = "<|turn|>", "\n", "<|end|>\n"
ESCAPES = [("\\", "\\s"), ("<", "\\l"), ("[", "\\b")]


def escape(text: Column) -> Column:
    """Without any < or [, so without any mark or control string; a backslash is only ever followed by s, l or b."""
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def escape_role(role: Column) -> Column:
    """As escape; a line break, which ends the role, becomes backslash n."""
    return F.replace(escape(role), F.lit(AFTER_ROLE), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit(AFTER_ROLE)))


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def field_paths(record: Column) -> Column:
    """The sorted leaf paths of a JSON text, such as messages[].role; null where it is no JSON object.

    A record beyond JSON_BYTES that the parser gives up is an error: it may be whole JSON that meets the parser's limits."""
    parsed = F.try_parse_json(record)
    schema = F.schema_of_variant(parsed)
    # OBJECT<a: ARRAY<OBJECT<b: STRING>>> : walk the schema's tokens with a stack of open names
    tokens = F.regexp_extract_all(schema, F.lit(r"(`[^`]*`|[A-Za-z0-9_]+): |(OBJECT<|ARRAY<)|(>)|([A-Z]+(?:\([0-9, ]*\))?)"), F.lit(0))
    start = F.struct(F.expr("cast(array() as array<string>)").alias("open"), F.lit("").alias("name"), F.expr("cast(array() as array<string>)").alias("paths"))

    def step(acc, t):
        top = F.coalesce(F.try_element_at(acc["open"], F.lit(-1)), F.lit(""))
        named = F.concat(top, F.when((top != "") & (acc["name"] != ""), ".").otherwise(""), acc["name"])
        return (
            F.when(F.endswith(t, F.lit(": ")), F.struct(acc["open"].alias("open"), F.regexp_replace(t, ": $|`", "").alias("name"), acc["paths"].alias("paths")))
            .when(t == "OBJECT<", F.struct(F.array_append(acc["open"], named).alias("open"), F.lit("").alias("name"), acc["paths"].alias("paths")))
            .when(t == "ARRAY<", F.struct(F.array_append(acc["open"], F.concat(named, F.lit("[]"))).alias("open"), F.lit("").alias("name"), acc["paths"].alias("paths")))
            .when(t == ">", F.struct(F.slice(acc["open"], 1, F.size(acc["open"]) - 1).alias("open"), F.lit("").alias("name"), acc["paths"].alias("paths")))
            .otherwise(F.struct(acc["open"].alias("open"), F.lit("").alias("name"), F.array_append(acc["paths"], named).alias("paths")))
        )

    walked = F.aggregate(tokens, start, step, lambda acc: F.array_sort(F.array_distinct(acc["paths"])))
    lost = parsed.isNull() & (F.octet_length(record) > JSON_BYTES)
    return F.when(lost, F.raise_error(F.concat(F.lit("a chat record cannot be read as JSON; bytes: "), F.octet_length(record).cast("string")))).when(schema.startswith("OBJECT<"), walked)


def _leaves(kind, path: str) -> list[str]:
    if isinstance(kind, StructType):
        return [x for f in kind for x in _leaves(f.dataType, f"{path}.{f.name}" if path else f.name)]
    return _leaves(kind.elementType, f"{path}[]") if isinstance(kind, ArrayType) else [path]


def struct_paths(record: Column, kind: StructType) -> Column:
    """As field_paths, of a struct: the paths of fields that are not null. No text is parsed, so any length will do."""

    def found(c, kind, path):
        if isinstance(kind, StructType):
            return [x for f in kind for x in found(c[f.name], f.dataType, f"{path}.{f.name}" if path else f.name)]
        return [F.when(c.isNotNull(), F.array(*map(F.lit, _leaves(kind, path)))).otherwise(F.expr("cast(array() as array<string>)"))]

    return F.when(record.isNotNull(), F.array_sort(F.flatten(F.array(*found(record, kind, "")))))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def canonical(record: Column, mark: Column) -> Column:
    """The turns of a record whose field paths have the fingerprint `mark`; null for layouts that are not known.

    Roles get their canonical names; an absent or null text is empty.
    """
    v = F.try_parse_json(record)
    return _mapped(
        mark,
        LAYOUTS,
        lambda path: F.try_variant_get(v, f"$.{path}", "string"),
        lambda array, role, text: F.try_variant_get(v, f"$.{array}", f"array<struct<`{role}`:string,`{text}`:string>>"),
    )


def struct_canonical(record: Column, kind: StructType, mark: Column) -> Column:
    """As canonical, of a struct; layouts with fields that it cannot have are left out."""
    have = set(_leaves(kind, ""))

    def at(path):
        c = record
        for name in path.split("."):
            c = c[name]
        return c

    return _mapped(mark, [paths for paths in LAYOUTS if have.issuperset(paths)], lambda path: at(path).cast("string"), lambda array, role, text: at(array))


def _mapped(mark: Column, layouts, text_at, turns_at) -> Column:
    out = F.lit(None).cast(TURNS)
    for paths in layouts:
        how = LAYOUTS[paths]
        if isinstance(how, tuple):
            turns = F.transform(turns_at(*how), _turn(*how[1:]))
        else:
            turns = F.array(*(F.struct(F.lit(role).alias("role"), F.coalesce(text_at(path), F.lit("")).alias("text")) for role, path in how))
        out = F.when(mark == F.xxhash64(F.lit("\n".join(paths))), turns).otherwise(out)
    return out


def _turn(role: str, text: str):
    return lambda t: F.struct(canonical_role(t[role]).alias("role"), F.coalesce(t[text], F.lit("")).alias("text"))


def canonical_role(role: Column) -> Column:
    out = F.coalesce(role, F.lit(""))
    for other, name in ROLES.items():
        out = F.when(role == other, F.lit(name)).otherwise(out)
    return out


def convert(records: DataFrame, record_col: str = "record") -> DataFrame:
    """records (structs or JSON texts) with field_paths, fingerprint and turns (null where the layout is not known)."""
    record, kind = F.col(record_col), records.schema[record_col].dataType
    whole = isinstance(kind, StructType)
    marked = records.withColumn("field_paths", struct_paths(record, kind) if whole else field_paths(record)).withColumn("fingerprint", fingerprint(F.col("field_paths")))
    return marked.withColumn("turns", struct_canonical(record, kind, F.col("fingerprint")) if whole else canonical(record, F.col("fingerprint")))


def render(turns: DataFrame) -> DataFrame:
    """turns (array of role, text) as a column formatted, and loss_spans: code points from start to end of each assistant text."""
    piece = F.transform("turns", lambda t: F.concat(F.lit(BEGIN), escape_role(t["role"]), F.lit(AFTER_ROLE), escape(t["text"]), F.lit(FINISH)))
    with_pieces = turns.withColumn("pieces", piece)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:long,stop:long>>)").alias("spans"))
    walked = F.aggregate(
        F.arrays_zip("turns", "pieces"),
        start,
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["pieces"])).alias("at"),
            F.when(
                x["turns"]["role"] == "assistant",
                F.array_append(acc["spans"], F.struct((acc["at"] + len(BEGIN) + F.length(escape_role(x["turns"]["role"])) + len(AFTER_ROLE)).alias("start"), (acc["at"] + F.length(x["pieces"]) - len(FINISH)).alias("stop"))),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return with_pieces.withColumn("formatted", F.array_join("pieces", "")).withColumn("loss_spans", walked).drop("pieces")


def parse(formatted: Column) -> Column:
    """The turns that a formatted text holds; marks cannot stand inside texts, so cutting at them is exact."""
    parts = F.filter(F.split(formatted, r"\Q" + BEGIN + r"\E", -1), lambda p: p != "")

    def turn(p):
        role = F.substring_index(p, AFTER_ROLE, 1)
        text = p.substr(F.length(role) + F.lit(len(AFTER_ROLE) + 1), F.length(p) - F.length(role) - F.lit(len(AFTER_ROLE) + len(FINISH)))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def masked(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, end to end."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")


def conversation_records(turns: DataFrame) -> DataFrame:
    """(conv_id, record): the rows of a conversation, ordered by turn (ties by role and text), as a struct.

    A user and an assistant alone become prompt and completion; system, user, assistant become instruction, input and output;
    every other one a list of messages; the other fields are null. Null texts and roles are empty. Rows of a null conv_id are
    one conversation.
    """
    rows = turns.select("conv_id", F.struct(F.coalesce("turn", F.lit(-1).cast("long")).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    roles = F.array_join("t.role", ",")
    text = lambda k: F.element_at("t", k)["text"]
    pair, three = roles == "user,assistant", roles == "system,user,assistant"
    record = F.struct(
        *(F.when(pair, text(k)).alias(name) for k, name in enumerate(("prompt", "completion"), 1)),
        *(F.when(three, text(k)).alias(name) for k, name in enumerate(("instruction", "input", "output"), 1)),
        F.when(~pair & ~three, F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))).alias("messages"),
    )
    return got.select("conv_id", record.alias("record"))


def op9_chat_format(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    out = render(convert(conversation_records(rows.unionByName(extra))))
    back = out.select("conv_id", "formatted", parse(F.col("formatted")).alias("read"), masked(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    line = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(line.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The same rows from the conversations as they are: digests of the turns themselves, and the length that the template makes.
OP9_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + length(text) + 17
           + length(role || text) - length(replace(replace(replace(role || text, chr(92), ''), '<', ''), '[', '')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
