"""Chat formatting by schema fingerprint.

The nested field paths of a record are sorted and hashed; the hash selects a
declarative mapping that says where turns, roles and texts lie.  A record whose
exact fingerprint is unknown takes the most specific mapping whose paths it has.
A table of one row for each turn is gathered by the mapping of its own columns'
fingerprint; ``as_records`` writes its conversations as JSON records in the layouts that
can hold them, which ``canonical_records`` reads back one by one.
Whatever the layout, the result is a list of canonical turns (role, text), which
the template writes as ``<|im_start|>role\\ntext<|im_end|>\\n``.

Control strings inside texts are escaped reversibly: one backslash is put before
the bar of every ``<|``, ``<\\|``, ``<\\\\|`` and so on, so no text can open or close a turn.
Roles are percent-encoded where they hold a line feed, a bar or a percent sign.
The loss mask is a list of spans (code points of the formatted text) that cover
exactly the texts of assistant turns.

Defined results: a null role or text is empty; turns with equal number are ordered
by role, then text; repeated rows are repeated turns; rows with a null
conversation id form one conversation; a record in no known layout gives no turns
and a null layout; an empty table gives an empty result.  A conversation is one
string by definition of the format, so it must fit a task, at some ten times its
length.  Other columns of a table of turns are not read; those of a table of records
stay, and a column named ``layout`` or ``turns`` there is replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import small_batches

START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Mapping:
    """``turns``: path of the list of messages, with ``role`` and ``text`` below it;
    or ``flat``: (role, paths) pairs read from the record itself, the paths joined
    by a blank line."""

    name: str
    turns: str = ""
    role: str = ""
    text: str = ""
    flat: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    @property
    def paths(self) -> frozenset[str]:
        if self.turns:
            return frozenset({f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"})
        return frozenset(p for _, ps in self.flat for p in ps)


ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
MAPPINGS = (
    Mapping("messages", "messages", "role", "content", roles=ALIASES),
    Mapping("messages_parts", "messages", "role", "content[].text", roles=ALIASES),
    Mapping("conversations", "conversations", "from", "value", roles=ALIASES),
    Mapping("dialogue", "dialogue", "speaker", "text", roles=ALIASES),
    Mapping("turns", "turns", "role", "text"),
    Mapping("contents_parts", "contents", "role", "parts[].text", roles=ALIASES),
    Mapping("instruction_input", flat=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("instruction", flat=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction_response", flat=(("user", ("instruction",)), ("assistant", ("response",)))),
    Mapping("system_prompt_response", flat=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt_response", flat=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt_completion", flat=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("question_answer", flat=(("user", ("question",)), ("assistant", ("answer",)))),
)
#: A table with one row for each turn: fingerprint of its columns → their part.
ROWS = {
    ("conv_id", "role", "text", "turn"): {"id": "conv_id", "order": "turn", "role": "role", "text": "text"},
    ("content", "conversation_id", "message_index", "role"): {"id": "conversation_id", "order": "message_index", "role": "role", "text": "content"},
}


def fingerprint(paths) -> str:
    return hashlib.blake2b("\n".join(sorted(paths)).encode(), digest_size=8).hexdigest()


def field_paths(value, at: str = "") -> set[str]:
    """Paths of the leaves of a JSON value; lists count as ``[]`` whatever their length."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in field_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """The same paths from a Spark type."""
    if isinstance(kind, T.StructType):
        return {p for f in kind for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)}
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {at}


def choose(paths: set[str], mappings=MAPPINGS, known: dict | None = None) -> Mapping | None:
    """The mapping of these paths: by fingerprint, else the most specific that fits."""
    key = fingerprint(paths)
    exact = {fingerprint(m.paths): m for m in mappings}
    if known is not None and key in known:
        return known[key]
    m = exact.get(key) or max((m for m in mappings if m.paths <= paths), key=lambda m: len(m.paths), default=None)
    if known is not None:
        known[key] = m
    return m


def _read(value, path: str) -> str:
    """Text at a path; texts of a list are joined."""
    if not path:
        return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    head, _, rest = path.partition(".")
    if head.endswith("[]"):
        items = value.get(head[:-2]) if isinstance(value, dict) else None
        return "".join(_read(v, rest) for v in items or ())
    return _read(value.get(head), rest) if isinstance(value, dict) else ""


def apply_mapping(m: Mapping | None, record) -> list[tuple[str, str]]:
    if m is None:
        return []
    if m.turns:
        out = []
        for turn in record.get(m.turns) or ():
            role = _read(turn, m.role)
            out.append((m.roles.get(role, role), _read(turn, m.text)))
        return out
    out = [(role, "\n\n".join(t for t in (_read(record, p) for p in paths) if t)) for role, paths in m.flat]
    return [(r, t) for r, t in out if t or r != "system"]


_OPEN = re.compile(r"<(\\*)\|")
_SHUT = re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    return _OPEN.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return role.replace("%", "%25").replace("\n", "%0A").replace("|", "%7C")


def unescape_role(role: str) -> str:
    return role.replace("%0A", "\n").replace("%7C", "|").replace("%25", "%")


def format_turns(turns) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text and loss spans."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role or '')}\n", escape(text or "")
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that a formatted text holds."""
    out = []
    for piece in formatted.split(f"{END}\n")[:-1]:
        role, _, text = piece.removeprefix(START).partition("\n")
        out.append((unescape_role(role), unescape(text)))
    return out


def under_mask(formatted: str, spans) -> str:
    return "".join(unescape(formatted[a:b]) for a, b in spans)


TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def canonical_rows(df: DataFrame) -> DataFrame:
    """(conv_id, turns) from a table of one row for each turn; the fingerprint of
    its schema selects the columns, columns beyond them being ignored."""
    paths = schema_paths(df.schema)
    known = {fingerprint(k): v for k, v in ROWS.items()}
    m = known.get(fingerprint(paths)) or next((v for k, v in ROWS.items() if set(k) <= paths), None)
    if m is None:
        raise ValueError(f"no mapping for the layout {fingerprint(paths)} of {sorted(paths)}")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col(m["order"]).alias("at"), text(m["role"]).alias("role"), text(m["text"]).alias("text"))
    rows = df.groupBy(F.col(m["id"]).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return rows.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def as_records(turns: DataFrame) -> DataFrame:
    """(conv_id, record): each conversation as a JSON record, in one of the layouts that
    hold it without loss, chosen by a hash of its id."""
    roles = F.transform("turns", lambda t: t["role"])
    text = lambda k: F.get("turns", F.lit(k))["text"]

    def messages(key: str, role: str, content: str, parts: bool = False):
        body = lambda t: F.array(F.struct(t["text"].alias("text"))) if parts else t["text"]
        return F.to_json(F.struct(F.transform("turns", lambda t: F.struct(t["role"].alias(role), body(t).alias(content))).alias(key)))

    def flat(**fields):
        return F.to_json(F.struct(*(text(k).alias(name) for name, k in fields.items())))

    def one_of(*records):
        out = records[0]
        for k, r in enumerate(records[1:], 1):
            out = F.when(F.pmod(F.xxhash64("conv_id"), F.lit(len(records))) == k, r).otherwise(out)
        return out

    several = (
        messages("messages", "role", "content"),
        messages("messages", "role", "content", parts=True),
        messages("conversations", "from", "value"),
        messages("dialogue", "speaker", "text"),
        messages("contents", "role", "parts", parts=True),
        messages("turns", "role", "text"),
    )
    pair = (flat(instruction=0, response=1), flat(prompt=0, response=1), flat(prompt=0, completion=1), flat(question=0, answer=1))
    record = (
        F.when(F.arrays_overlap(roles, F.array(*map(F.lit, ALIASES))), several[-1])  # this layout alone keeps them
        .when(roles == F.array(F.lit("user"), F.lit("assistant")), one_of(*several, *pair))
        .when((roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))) & (text(0) != ""), one_of(*several, flat(system=0, prompt=1, response=2)))
        .otherwise(one_of(*several))
    )
    return turns.select("conv_id", record.alias("record"))


def canonical_records(df: DataFrame, record_col: str, mappings=MAPPINGS) -> DataFrame:
    """Adds ``layout`` and ``turns`` to a table of JSON records in mixed layouts."""
    small_batches(df.sparkSession)
    names = [c for c in df.columns if c not in ("layout", "turns")]

    def run(batches):
        known: dict = {}
        for batch in batches:
            layouts, turns = [], []
            for raw in batch.column(batch.schema.get_field_index(record_col)).to_pylist():
                try:
                    record = json.loads(raw or "null")
                except ValueError:
                    record = None
                m = choose(field_paths(record), mappings, known) if isinstance(record, dict) else None
                layouts.append(m.name if m else None)
                turns.append([{"role": r, "text": t} for r, t in apply_mapping(m, record)])
            cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(layouts, pa.string()), pa.array(turns, _TURNS)], names=[*names, "layout", "turns"])

    fields = [*(df.schema[c] for c in names), T.StructField("layout", T.StringType()), T.StructField("turns", TURNS)]
    return df.select(*names).mapInArrow(run, T.StructType(fields))


def formatted(df: DataFrame) -> DataFrame:
    """Replaces ``turns`` by ``formatted`` and ``loss_spans``."""
    small_batches(df.sparkSession)
    names = [c for c in df.columns if c != "turns"]

    def run(batches):
        for batch in batches:
            both = [format_turns([(t["role"], t["text"]) for t in turns or ()]) for turns in batch.column(batch.schema.get_field_index("turns")).to_pylist()]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in both], _SPANS)
            yield pa.RecordBatch.from_arrays([*cols, pa.array([f for f, _ in both], pa.string()), spans], names=[*names, "formatted", "loss_spans"])

    fields = [*(df.schema[c] for c in names), T.StructField("formatted", T.StringType()), T.StructField("loss_spans", SPANS)]
    return df.mapInArrow(run, T.StructType(fields))


def read_back(df: DataFrame) -> DataFrame:
    """Digests read from ``formatted`` and ``loss_spans`` alone."""
    small_batches(df.sparkSession)
    new = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches):
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c))
            rows = []
            for f, spans in zip(col("formatted").to_pylist(), col("loss_spans").to_pylist()):
                turns, loss = parse(f), under_mask(f, [(s["start"], s["end"]) for s in spans])
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(f)))
            out = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([col("conv_id"), *(pa.array(v, k) for v, k in zip(out, kinds))], names=["conv_id", *new])

    kinds = [T.LongType(), T.StringType(), T.LongType(), T.StringType(), T.LongType()]
    return df.mapInArrow(run, T.StructType([df.schema["conv_id"], *(T.StructField(n, k) for n, k in zip(new, kinds))]))


PROBE = f"{END}{START}assistant ok"


def with_probe(turns: DataFrame) -> DataFrame:
    """Adds conversation -1 to canonical turns; its two texts try to close a turn and
    open another."""
    both = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(PROBE).alias("text")) for r in ("user", "assistant")))
    probe = turns.sparkSession.range(1).select(F.lit(-1).cast(turns.schema["conv_id"].dataType).alias("conv_id"), both.alias("turns"))
    return turns.select("conv_id", "turns").unionByName(probe)


def oracle() -> str:
    return rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(START) + len(END) + 2} + length(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '|', '%7C'))
    + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""
