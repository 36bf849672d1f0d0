"""Chat formatting from heterogeneous layouts, in DataFrame functions only.

The layout of a record is told by a fingerprint: the hash of its sorted nested field paths, which lead through objects and
arrays of any depth to the leaves. A table of declarative mappings, keyed by fingerprint, says where the turns are; unknown fingerprints, as of records with further fields, fall
back to the mapping with the most required paths that are all there. A record that no mapping fits has no turns and is
told by ``layouts_json``. All layouts become rows (conversation, turn, role, text), and those one formatted text each:

    <|im_start|>role \\n text <|im_end|> \\n

Control strings inside texts are escaped by a backslash within ``<|``, which can be undone exactly; roles are URL-encoded.
The loss mask is a list of byte spans, one for each assistant text, so that it is read back by slicing."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

START, STOP = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"


@dataclass(frozen=True)
class Mapping:
    """Where the turns of one layout are: ``turns`` are array fields, one behind the other, with role and text fields, the
    text being one value or a list of parts; or ``fixed`` lists (role, path) in order; ``rows`` says that a record is one
    turn."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[str, ...] = ()
    role: str | None = None
    text: str | None = None
    fixed: tuple[tuple[str, str], ...] = ()
    rows: bool = False

    def within(self, key: str) -> "Mapping":
        """The same layout inside an object."""
        inner = lambda path: "+".join(f"{key}.{p}" for p in path.split("+"))
        return replace(self, name=f"{key}.{self.name}", paths=tuple(map(inner, self.paths)), turns=tuple(map(inner, self.turns)), fixed=tuple((r, inner(p)) for r, p in self.fixed))


#: Objects that hold a whole record of another layout.
WRAPPERS = ("data",)
_PLAIN = (
    Mapping("rows", ("conv_id", "role", "text", "turn"), rows=True, role="role", text="text"),
    Mapping("messages", ("messages[].content", "messages[].role"), turns=("messages",), role="role", text="content"),
    Mapping("message_parts", ("messages[].content[].text", "messages[].content[].type", "messages[].role"), turns=("messages",), role="role", text="content"),
    Mapping("prompt_turns", ("completion[].content", "completion[].role", "prompt[].content", "prompt[].role"), turns=("prompt", "completion"), role="role", text="content"),
    Mapping("shares", ("conversations[].from", "conversations[].value"), turns=("conversations",), role="from", text="value"),
    Mapping("instruction_input", ("input", "instruction", "output"), fixed=(("user", "instruction+input"), ("assistant", "output"))),
    Mapping("instruction", ("instruction", "output"), fixed=(("user", "instruction"), ("assistant", "output"))),
    Mapping("system_prompt", ("prompt", "response", "system"), fixed=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt", ("prompt", "response"), fixed=(("user", "prompt"), ("assistant", "response"))),
    Mapping("completion", ("completion", "prompt"), fixed=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("question", ("answer", "question"), fixed=(("user", "question"), ("assistant", "answer"))),
)
MAPPINGS = _PLAIN + tuple(m.within(key) for key in WRAPPERS for m in _PLAIN if not m.rows)
#: Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested paths of a schema's leaves; an array adds ``[]``."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, prefix + "[]")
    return [prefix]


def fingerprint_of(paths) -> int:
    """xxhash64 of the sorted paths, as Spark computes it on the executors (from the standard seed, 42)."""
    import xxhash

    value = xxhash.xxh64_intdigest("\n".join(sorted(paths)).encode("utf-8"), seed=42)
    return value - (1 << 64) if value >= 1 << 63 else value


REGISTRY = {fingerprint_of(m.paths): m for m in MAPPINGS}


def mapping_for(paths: list[str]) -> Mapping:
    """By fingerprint; else, as with extra columns, the mapping with the most required paths that are all there."""
    exact = REGISTRY.get(fingerprint_of(paths))
    if exact is not None:
        return exact
    fit = [m for m in MAPPINGS if set(m.paths) <= set(paths)]
    if not fit:
        raise ValueError(f"no mapping for the fields {', '.join(paths)}")
    return max(fit, key=lambda m: len(m.paths))


def _role(column: Column) -> Column:
    column = F.coalesce(column.cast("string"), F.lit(""))
    return F.coalesce(F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])[F.lower(column)], column)


def canonical_turns(records: DataFrame, id_col: str = "conv_id", id_type: str = "long") -> DataFrame:
    """``conv_id, turn, role, text`` of records of any known layout (by schema). Null texts and roles are empty, so a
    null instruction is a turn too; only a system text, which a record need not have, makes no turn where it is null.
    Extra columns are ignored; a schema that no mapping fits is an error."""
    # The identity's own path stands for any name that the id column has; only the layout of rows has it.
    paths = [p for p in field_paths(records.schema) if p != id_col]
    m = mapping_for(sorted([*paths, "conv_id"]) if {"turn", "role", "text"} <= set(paths) else paths)
    identity = F.col(id_col).cast(id_type).alias("conv_id")
    if m.rows:
        return records.select(identity, F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if m.turns:
        return _exploded(records, identity, F.concat(*[_listed(records, m, path) for path in m.turns]))
    return _exploded(records, identity, _fixed_turns(m, lambda p: F.col(p).cast("string")))


def _fixed_turns(m: Mapping, get) -> Column:
    def text(role: str, path: str) -> Column:
        first, *rest = path.split("+")
        head = get(first) if role == "system" else F.coalesce(get(first), F.lit(""))
        return F.concat(head, *[F.when(F.coalesce(F.length(get(p)), F.lit(0)) > 0, F.concat(F.lit("\n\n"), get(p))).otherwise("") for p in rest])

    return F.array(*[F.struct(F.lit(r).alias("role"), text(r, p).alias("text")) for r, p in m.fixed])


def _listed(records: DataFrame, m: Mapping, path: str) -> Column:
    """The turns of an array column; a null one has none. The texts of a list of parts are joined, parts without one add
    nothing."""
    kind = records.select(F.col(path).alias("x")).schema["x"].dataType.elementType[m.text].dataType
    part = (lambda p: p["text"].cast("string")) if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) else (lambda p: p.cast("string"))
    said = (lambda x: F.array_join(F.transform(x[m.text], part), "")) if isinstance(kind, T.ArrayType) else (lambda x: x[m.text].cast("string"))
    turns = F.transform(path, lambda x: F.struct(_role(x[m.role]).alias("role"), F.coalesce(said(x), F.lit("")).alias("text")))
    return F.coalesce(turns, F.array().cast("array<struct<role:string,text:string>>"))


def _listed_json(json: Column, m: Mapping, path: str) -> Column:
    """The same of JSON, where one turn's text may be a value and the next one's a list of parts."""
    plain = lambda v: F.try_variant_get(v, "$", "string")
    part = lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.when(F.schema_of_variant(p) == "STRING", plain(p)))
    said = lambda v: F.when(F.schema_of_variant(v).startswith("ARRAY"), F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), part), "")).otherwise(plain(v))
    turns = F.try_variant_get(F.try_parse_json(json), f"$.{path}", f"array<struct<`{m.role}`:variant,`{m.text}`:variant>>")
    return F.transform(turns, lambda x: F.struct(_role(plain(x[m.role])).alias("role"), F.coalesce(said(x[m.text]), F.lit("")).alias("text")))


def _exploded(records: DataFrame, identity: Column, turns: Column) -> DataFrame:
    out = records.select(identity, F.posexplode(turns).alias("turn", "m")).where(F.col("m.text").isNotNull())
    return out.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("m.role").alias("role"), F.col("m.text").alias("text"))


#: What a variant's schema is made of: a key with its colon, an opening, a closing, or the type of a leaf.
_SCHEMA_TOKEN = r"`(?:[^`]|``)*`: |[^\s<>,`:()]+: |OBJECT<|ARRAY<|>|[A-Z_]+(?:\(\d+,\d+\))?"


def json_paths(json: Column) -> Column:
    """Sorted paths of a JSON value's leaves, at any depth: keys parted by dots (those of other characters than ASCII
    letters, digits and _ in backquotes), ``[]`` for an array, which has the paths of all of its elements. An array with both objects and other elements is a leaf. Null
    where the JSON is null, invalid, has a key twice in one object, or is beyond the size of a variant (128 MB)."""
    tokens = F.regexp_extract_all(F.schema_of_variant(F.try_parse_json(json)), F.lit(_SCHEMA_TOKEN), F.lit(0))
    texts = F.array().cast("array<string>")
    state = lambda stack, now, out: F.struct(stack.alias("stack"), now.alias("now"), out.alias("out"))

    def step(s: Column, token: Column) -> Column:
        stack, now, out = s["stack"], s["now"], s["out"]
        top = F.element_at(stack, -1)
        key = F.substring(token, F.lit(1), F.length(token) - 2)
        return (
            F.when(token.endswith(": "), state(stack, F.when(top == "", key).otherwise(F.concat(top, F.lit("."), key)), out))
            .when(token == "OBJECT<", state(F.concat(stack, F.array(now)), now, out))
            .when(token == "ARRAY<", state(F.concat(stack, F.array(F.concat(now, F.lit("[]")))), F.concat(now, F.lit("[]")), out))
            .when(token == ">", state(F.slice(stack, F.lit(1), F.size(stack) - 1), F.lit(""), out))
            .otherwise(state(stack, now, F.concat(out, F.array(now))))
        )

    start = state(F.array(F.lit("")), F.lit(""), texts)
    return F.array_sort(F.array_distinct(F.aggregate(tokens, start, step, lambda s: s["out"])))


def layouts_json(records: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``conv_id, j, layout``: which mapping each JSON record is read by, null where none fits (or ``json_paths`` is null)."""
    marked = records.select(F.col(id_col).cast("long").alias("conv_id"), F.col(json_col).cast("string").alias("j"))
    # The paths come out of a generator of one row, so that they are computed once.
    marked = marked.select("conv_id", "j", F.explode_outer(F.array(json_paths(F.col("j")))).alias("paths")).withColumn("fingerprint", F.xxhash64(F.array_join("paths", "\n")))
    layout = F.lit(None).cast("string")
    for m in sorted(MAPPINGS, key=lambda m: len(m.paths)):  # the last that fits has the most paths
        if not m.rows:
            layout = F.when(F.size(F.array_except(F.lit(list(m.paths)), F.col("paths"))) == 0, m.name).otherwise(layout)
    for key, m in REGISTRY.items():
        if not m.rows:
            layout = F.when(F.col("fingerprint") == key, m.name).otherwise(layout)
    return marked.select("conv_id", "j", layout.alias("layout"))


def canonical_turns_json(records: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``conv_id, turn, role, text`` of JSON records, each with a layout of its own; texts and roles as in
    ``canonical_turns``. Records without a layout have no turns; ``layouts_json`` returns them."""
    options = none = F.array().cast("array<struct<role:string,text:string>>")
    for m in MAPPINGS:
        if m.rows:
            continue
        if m.turns:
            turns = F.concat(*[F.coalesce(_listed_json(F.col("j"), m, path), none) for path in m.turns])
        else:
            turns = _fixed_turns(m, lambda p: F.get_json_object("j", f"$.{p}"))
        options = F.when(F.col("layout") == m.name, turns).otherwise(options)
    return _exploded(layouts_json(records, id_col, json_col), F.col("conv_id"), options)


def escape(text: Column) -> Column:
    """``<|`` with any backslashes between gets one more, so no control string is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, formatted, loss_spans`` from ``conv_id, turn, role, text``.

    Turns are in order of turn, then role and text, so ties and repeated rows have a defined place; null roles and texts
    are empty; rows of a null conv_id are one conversation. loss_spans are (start, length) in bytes of the formatted
    text. A conversation is one row, and that is all that must fit in a task at a time.
    """
    piece = F.concat(F.lit(START), F.url_encode("role"), F.lit("\n"), F.col("escaped"), F.lit(STOP + "\n"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("escaped"))
    rows = rows.select("conv_id", "turn", "role", "escaped", piece.alias("piece"), F.octet_length("escaped").cast("long").alias("size"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "escaped")
    rows = rows.withColumn("end", F.sum(F.octet_length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.when(F.col("role") == ASSISTANT, F.struct((F.col("end") - len(STOP + "\n") - F.col("size")).alias("start"), F.col("size").alias("length")))
    rows = rows.select("conv_id", "end", "piece", span.alias("span"))
    out = rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("end", "piece"))).alias("p"), F.sort_array(F.collect_list("span")).alias("loss_spans"))
    return out.select("conv_id", "n_turns", F.array_join(F.col("p.piece"), "").alias("formatted"), "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns array<struct<role,text>>, loss_text, formatted`` parsed from the formatted text and its spans."""
    parts = F.split(F.col("formatted"), r"<\|im_end\|>\n")
    body = lambda s: F.substring(s, F.lit(len(START) + 1), F.length(s))
    role = lambda s: F.substring_index(body(s), "\n", 1)
    turns = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda s: F.struct(F.url_decode(role(s)).alias("role"), unescape(F.substring(body(s), F.length(role(s)) + 2, F.length(s))).alias("text")))
    raw = F.col("formatted").cast("binary")
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(raw, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string")))
    return formatted.select("conv_id", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"), "formatted")
