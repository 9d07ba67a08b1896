r"""Chat formatting by schema fingerprints. Built-in functions only.

A record, a struct column or a JSON string, gets a fingerprint: the hash of its sorted nested field paths, by the types
that the fields have and never by what their texts look like. A fingerprint selects a declarative mapping, which says
where the turns are and how each becomes (role, text). Mapped layouts: ``messages`` / ``conversations`` / ``turns`` lists,
``prompt``/``completion`` (or ``response``) and ``question``/``answer`` pairs, and ``instruction``/``input``/``output``
triples. Records whose fingerprint no mapping has come out with null turns and their fingerprint, so they can be counted
and mapped, never guessed. Rows of a table with a row a turn become ``turns`` lists, without any detour over JSON.

Template: each turn is ``### role:``, a line feed, the text, a line feed, ``</turn>``, a line feed. Inside texts a
backslash becomes ``\\``, ``###`` becomes ``\###`` and ``</turn>`` becomes ``\</turn>``, so ``</turn>`` stands behind
a line feed only where a turn closes; reading undoes this from left to right and every text comes back as it was.
The loss mask covers the texts of assistant turns, without their markers.

Edge cases: a null text is empty, a null role is the role ``unknown``; roles keep their spelling, escaped like
texts; turns are ordered by number, then role, then text (repeated rows stay; null numbers first); an empty table
gives the extra conversation alone; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

OPEN, AFTER_ROLE, CLOSE = "### ", ":\n", "\n</turn>\n"
LOSS_ROLE = "assistant"
EXTRA_ID, EXTRA_TEXT = -7, r"\### Assistant: </turn> ok"


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("###"), F.lit("\\###"))
    return F.replace(text, F.lit("</turn>"), F.lit("\\</turn>"))


def unescaped(text: Column) -> Column:
    """The inverse of ``escaped``: a backslash stands for nothing but itself before the next character."""
    return F.regexp_replace(text, r"(?s)\\(\\|###|</turn>)", "$1")


def paths(schema: T.DataType, at: str = "") -> list[str]:
    """The nested field paths of a schema; elements of an array are at ``[]``."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return paths(schema.elementType, f"{at}[]")
    return [at]


def fingerprint_of(names: list[str]) -> str:
    """The fingerprint of a list of field paths, equal to ``fingerprint`` of a record that has these fields."""
    import hashlib

    return hashlib.sha256("\n".join(sorted(set(names))).encode()).hexdigest()


# Where each layout has its turns: a list with the fields of role and text (and whether its roles have names of their
# own), or fields that follow one another.
MAPPINGS = {
    ("messages[].content", "messages[].role"): ("list", "messages", "role", "content", False),
    ("messages[].role", "messages[].text"): ("list", "messages", "role", "text", False),
    ("conversations[].from", "conversations[].value"): ("list", "conversations", "from", "value", True),
    ("turns[].role", "turns[].text"): ("list", "turns", "role", "text", False),
    ("turns[].text",): ("list", "turns", "role", "text", False),
    ("turns[].role",): ("list", "turns", "role", "text", False),
    ("completion", "prompt"): ("fields", [("user", ["prompt"]), ("assistant", ["completion"])]),
    ("prompt", "response"): ("fields", [("user", ["prompt"]), ("assistant", ["response"])]),
    ("question", "answer"): ("fields", [("user", ["question"]), ("assistant", ["answer"])]),
    ("instruction", "output"): ("fields", [("user", ["instruction"]), ("assistant", ["output"])]),
    ("input", "instruction", "output"): ("fields", [("user", ["instruction", "input"]), ("assistant", ["output"])]),
}
# Names of roles in layouts that have their own.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

LISTS = ("messages", "conversations", "turns")
TEXTS = ("prompt", "completion", "response", "question", "answer", "instruction", "input", "output")
_ITEM = ("role", "content", "text", "from", "value")
_OBJECTS = T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in _ITEM]))
WIDE = T.StructType([T.StructField(n, _OBJECTS) for n in LISTS] + [T.StructField(n, T.StringType()) for n in TEXTS])
_TURNS = "array<struct<role:string,text:string>>"
# Texts may be as long as a string can be.
_JSON = {"maxStringLen": str((1 << 31) - 1)}


def _hashed(names: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(names)), "\n"), 256)


def _present(value: Column, kind: T.DataType, at: str) -> Column:
    """The paths of the fields below ``at`` that hold something."""
    if isinstance(kind, T.StructType):
        return F.concat(*[_present(value[f.name], f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields])
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        inner = [F.when(F.exists(value, lambda x: x[f.name].isNotNull()), F.lit(f"{at}[].{f.name}")) for f in kind.elementType.fields]  # noqa: B023
        return F.array_compact(F.array(*inner))
    return F.array_compact(F.array(F.when(value.isNotNull(), F.lit(f"{at}[]" if isinstance(kind, T.ArrayType) else at))))


def fingerprint(record: Column, schema: T.StructType | None = None) -> Column:
    """Of a struct column with its schema: the hash of the paths of its fields that are not null. Of a JSON string: the
    hash of all its paths, where the fields that mappings name are read by type (lists of objects by their elements'
    fields, other lists as ``[]``, objects by their fields) and others count by name."""
    if schema is not None:
        return _hashed(_present(record, schema, ""))
    keys = F.coalesce(F.map_keys(F.from_json(record, "map<string,string>", _JSON)), F.array().cast("array<string>"))
    shape = lambda kind: F.from_json(record, ", ".join(f"{n} {kind}" for n in (*LISTS, *TEXTS)), _JSON)
    lists, items, objects = shape("array<string>"), shape("array<map<string,string>>"), shape("map<string,string>")

    def nested(k: Column) -> Column:
        out = F.array(k)
        for n in (*LISTS, *TEXTS):
            fields = lambda m, dot: F.transform(F.map_keys(m), lambda x: F.concat(F.lit(f"{n}{dot}"), x))  # noqa: B023, E731
            out = F.when(
                k == n,
                F.when(F.size(objects[n]) > 0, fields(objects[n], "."))
                .when(F.size(items[n]) > 0, F.flatten(F.transform(F.filter(items[n], lambda m: m.isNotNull()), lambda m: fields(m, "[]."))))  # noqa: B023
                .when(lists[n].isNotNull(), F.array(F.lit(f"{n}[]")))
                .otherwise(F.array(k)),
            ).otherwise(out)
        return out

    return _hashed(F.flatten(F.transform(keys, nested)))


def with_turns(df: DataFrame, record: str, turns: str = "turns", mark: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of the column ``record`` (struct or JSON string) and the turns by the mapping that it
    selects, null if there is none."""
    kind = df.schema[record].dataType
    typed = isinstance(kind, T.StructType)
    df = df.withColumn(mark, fingerprint(F.col(record), kind if typed else None))
    wide = "__c_wide" if not typed else record
    df = df if typed else df.withColumn(wide, F.from_json(record, WIDE, _JSON))
    has = {f.name: f.dataType for f in (kind if typed else WIDE).fields}
    named, out = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair]), F.lit(None).cast(_TURNS)
    for names, (layout, *how) in MAPPINGS.items():
        if layout == "list":
            field, role, text, own = how
            if field not in has or not {role, text} <= set(getattr(getattr(has[field], "elementType", None), "names", ())):
                continue
            said = lambda m: F.coalesce(named[m[role]], m[role]) if own else m[role]  # noqa: B023, E731
            found = F.transform(F.col(wide)[field], lambda m: F.struct(said(m).alias("role"), m[text].alias("text")))  # noqa: B023
        else:
            if not {n for _, fields in how[0] for n in fields} <= set(has):
                continue
            found = F.array(*[F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*[F.col(wide)[n] for n in fields]), lambda x: x != ""), "\n").alias("text")) for role, fields in how[0]])
        out = F.when(F.col(mark) == fingerprint_of(list(names)), found.cast(_TURNS)).otherwise(out)
    return df.withColumn(turns, out).drop("__c_wide")


def _role(role: Column) -> Column:
    """A role on one line: a percent sign and a line feed by their codes."""
    return F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def formatted(turns: Column) -> Column:
    """The turns in the template, as one string."""
    one = lambda t: F.concat(F.lit(OPEN), escaped(_role(F.coalesce(t["role"], F.lit("unknown")))), F.lit(AFTER_ROLE), escaped(F.coalesce(t["text"], F.lit(""))), F.lit(CLOSE))
    return F.array_join(F.transform(turns, one), "")


def read_back(output: Column) -> Column:
    """The turns of a formatted string (role, text, and loss: whether the mask covers the text)."""
    pieces = F.filter(F.split(output, CLOSE, -1), lambda x: x != "")

    def turn(x: Column) -> Column:
        head = F.substring_index(x, AFTER_ROLE, 1)
        role = F.replace(F.replace(unescaped(F.substr(head, F.lit(len(OPEN) + 1))), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))
        return F.struct(role.alias("role"), unescaped(F.substr(x, F.length(head) + F.lit(len(AFTER_ROLE) + 1))).alias("text"), (role == LOSS_ROLE).alias("loss"))

    return F.transform(pieces, turn)


CHUNK = 64


def format_rows(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as one formatted string a conversation: conv_id, formatted.

    A conversation is put together from chunks of consecutive turn numbers, so that a very long one is formatted by
    many tasks and only finished strings meet."""
    record = F.struct(F.array(F.struct(F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))).alias("turns"))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), record.alias("record"))
    # The fingerprint is that of the row as it comes; a row with neither role nor text has no fields, and is an empty turn.
    said = F.coalesce(F.col("turns")[0], F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text")))
    rows = with_turns(rows, "record").withColumn("said", said)
    turn = F.struct("turn", F.coalesce("said.role", F.lit("unknown")).alias("role"), F.coalesce("said.text", F.lit("")).alias("text"))
    part = rows.groupBy("conv_id", F.floor(F.col("turn") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    part = part.select("conv_id", "chunk", formatted(F.col("turns")).alias("part"))
    whole = part.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "part"))).alias("parts"))
    return whole.select("conv_id", F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("formatted"))


def digests(output: DataFrame) -> DataFrame:
    """What reading ``output`` (conv_id, formatted) back gives: counts and digests of turns and of text under the mask."""
    back = output.withColumn("turns", read_back(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    back = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return back.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def formatted_conversations(rows: DataFrame) -> DataFrame:
    """All conversations and the extra one that probes the escapes, formatted and read back."""
    extra = rows.sparkSession.range(2).select(F.lit(EXTRA_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"), F.lit(EXTRA_TEXT).alias("text"))
    return digests(format_rows(rows.select("conv_id", "turn", "role", "text").unionByName(extra)))


QUERY_SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, length(role) + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) + 15 AS n FROM r)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
