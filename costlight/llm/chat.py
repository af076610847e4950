r"""Chat formatting by schema fingerprints.

A record's layout is known by the hash of its own nested field paths: the fingerprint selects a
declarative mapping that says where the turns, their roles and texts are, and so prompt,
instruction and message layouts all become canonical turns. Turns are then written as

    ### assistant: text</turn>\n

where a backslash, "###" and "</turn>" inside a text get a backslash before them (in roles also ": "),
so the output can be read back exactly. The loss mask covers the texts of assistant turns, without
the marks.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = "</turn>"
_TEXT = re.compile(r"\\|###|</turn>")
_ROLE = re.compile(r"\\|###|</turn>|: ")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|: )")
_TURN = re.compile(r"### ((?:[^\\:]++|\\(?:\\|###|</turn>|: )|:(?! ))*+): ((?:[^\\<]++|\\(?:\\|###|</turn>)|<(?!/turn>))*+)</turn>\n", re.S)

#: Names of roles in the layout that has "from" and "value", and their canonical names.
ROLES = (("human", "user"), ("prompter", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
_SURROGATE = re.compile("[\ud800-\udfff]")


@dataclass(frozen=True)
class Mapping:
    """Where a layout has its turns.

    turns: path of a list of turns with fields role and text (parts: the text is a list of objects, whose field of this name is joined);
    or else fields: (role, path) pairs, one turn each, in order, where blank optional fields give no turn. rename: names
    of roles that this layout has of its own; all other roles stay as they are given.
    """

    name: str
    turns: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    parts: str = ""
    rename: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[str]:
        if self.turns:
            text = f"{self.turns}[].{self.text}"
            return sorted([f"{self.turns}[].{self.role}", *([f"{text}[].type", f"{text}[].{self.parts}"] if self.parts else [text])])
        return sorted(p for _, p in self.fields)


def fingerprint(paths: list[str]) -> str:
    """Hash of a set of nested field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


#: Layouts that are known from the start; register() adds more.
MAPPINGS = [
    Mapping("messages", turns="messages", role="role", text="content"),
    Mapping("message_parts", turns="messages", role="role", text="content", parts="text"),
    Mapping("turns", turns="turns", role="role", text="text"),
    Mapping("conversations", turns="conversations", role="from", text="value", rename=ROLES),
    Mapping("prompt_response", fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("instruction", fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", fields=(("system", "instruction"), ("user", "input"), ("assistant", "output")), optional=("input",)),
    Mapping("system_prompt", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Mapping("question_answer", fields=(("user", "question"), ("assistant", "answer"))),
    Mapping("prompt", fields=(("user", "prompt"),)),
    Mapping("response", fields=(("assistant", "response"),)),
]
REGISTRY = {fingerprint(m.paths()): m for m in MAPPINGS}


def register(mapping: Mapping) -> str:
    key = fingerprint(mapping.paths())
    REGISTRY[key] = mapping
    return key


def paths_of(value, at: str = "") -> list[str]:
    """Nested field paths of a decoded record; all elements of a list count."""
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in paths_of(v, f"{at}.{k}" if at else str(k))]
    if isinstance(value, list):
        return sorted({p for v in value for p in paths_of(v, f"{at}[]")}) or [f"{at}[]"]
    return [at]


def select_mapping(paths: list[str], registry: dict[str, Mapping] | None = None) -> Mapping | None:
    """By fingerprint. A record with more fields takes, of the mappings that it holds whole, one with most paths, and of these the first registered."""
    registry = REGISTRY if registry is None else registry
    if (found := registry.get(fingerprint(paths))) is not None:
        return found
    have = set(paths)
    return max((m for m in registry.values() if have.issuperset(m.paths())), key=lambda m: len(m.paths()), default=None)


def _string(value, parts: str = "") -> str:
    """Null: empty. Parts of a list: their texts. Other values: as JSON. Half surrogate pairs become U+FFFD."""
    if isinstance(value, list) and parts:
        value = "".join(x if isinstance(x, str) else _string(x.get(parts)) if isinstance(x, dict) else "" for x in value)
    out = "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return _SURROGATE.sub("\ufffd", out) if not out.isascii() else out


def canonical(record: dict, registry: dict[str, Mapping] | None = None, mapping: Mapping | None = None) -> list[tuple[str, str]] | None:
    """Turns (role, text) of a record, or None for a layout that no mapping knows or with a turn that isn't an object."""
    mapping = mapping or select_mapping(paths_of(record), registry)
    if mapping is None:
        return None

    def get(path: str):
        value = record
        for k in path.split("."):
            value = value.get(k) if isinstance(value, dict) else None
        return value

    if not mapping.turns:
        return [(role, _string(get(path))) for role, path in mapping.fields if path not in mapping.optional or _string(get(path)).strip()]
    turns, names = get(mapping.turns), dict(mapping.rename)
    if not isinstance(turns, list) or not all(isinstance(t, dict) for t in turns):
        return None
    roles = [_string(t.get(mapping.role)) for t in turns]
    return [(names.get(r, r), _string(t.get(mapping.text), mapping.parts)) for r, t in zip(roles, turns, strict=True)]


def write_turn(role: str, text: str) -> str:
    return f"### {_ROLE.sub(lambda m: chr(92) + m[0], role)}: {_TEXT.sub(lambda m: chr(92) + m[0], text)}{END}\n"


def read_turns(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role, text and where the escaped text begins and ends, of each turn."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((_ESCAPED.sub(r"\1", m[1]), _ESCAPED.sub(r"\1", m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


def format_record(record: dict, registry: dict[str, Mapping] | None = None) -> tuple[str, list[tuple[int, int]], str] | None:
    """Formatted text, the loss mask's spans and the layout's name, or None for an unknown layout."""
    mapping = select_mapping(paths_of(record), registry)
    turns = canonical(record, registry, mapping) if mapping else None
    if turns is None:
        return None
    out, spans, at = [], [], 0
    for role, text in turns:
        turn = write_turn(role, text)
        if role == "assistant":
            spans.append((at + len("### assistant: "), at + len(turn) - len(END) - 1))
        out.append(turn)
        at += len(turn)
    return "".join(out), spans, mapping.name


def _read(raw: str | None):
    try:
        return json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None


OWN = ("formatted", "loss_spans", "layout")


def format_json(df: DataFrame, record_column: str = "record") -> DataFrame:
    """Rows with a JSON record in any layout: adds formatted, loss_spans (start and end in code points) and layout.

    These are null for null and empty records, for what isn't a JSON object or is nested too deep to be read, for unknown
    layouts and for turns that aren't objects. Columns that already have these names are replaced. Repeated rows are
    treated alike; an empty table gives an empty result. The layouts are those registered when this is called.
    """
    registry = dict(REGISTRY)
    df = df.select(*(F.col(f"`{c}`") for c in df.columns if c not in OWN or c == record_column))
    at = df.columns.index(record_column)
    keep = [i for i, c in enumerate(df.columns) if c not in OWN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts, masks, names = [], [], []
            for raw in batch.column(at).to_pylist():
                record = _read(raw)
                try:
                    done = format_record(record, registry) if isinstance(record, dict) else None
                except RecursionError:
                    done = None
                texts.append(done[0] if done else None)
                masks.append([{"start": a, "end": b} for a, b in done[1]] if done else None)
                names.append(done[2] if done else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(texts, pa.string()), pa.array(masks, spans), pa.array(names, pa.string())], names=[*(batch.schema.names[i] for i in keep), *OWN])

    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([*(df.schema.fields[i] for i in keep), T.StructField("formatted", T.StringType()), T.StructField("loss_spans", T.ArrayType(span)), T.StructField("layout", T.StringType())])
    return df.mapInArrow(run, schema)


def turn_records(df: DataFrame) -> DataFrame:
    """conv_id, turn and record of a table with one row per turn (conv_id, turn, role, text): each turn as a JSON record.

    Conversations come in the layouts of different sources, by their conv_id: lists of messages, of parts of messages, of
    turns, of "from" and "value", or single fields. Null role or text: empty.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = lambda name, *fields: F.to_json(F.struct(F.array(F.struct(*fields)).alias(name)))
    kind = F.pmod(F.coalesce(F.hash("conv_id"), F.lit(0)), F.lit(5))
    known = role.isin("user", "assistant")
    record = (
        F.when((kind == 1) & known, one("conversations", F.when(role == "user", "human").otherwise("gpt").alias("from"), text.alias("value")))
        .when(kind == 2, one("turns", role.alias("role"), text.alias("text")))
        .when((kind == 3) & (role == "user"), F.to_json(F.struct(text.alias("prompt"))))
        .when((kind == 3) & (role == "assistant"), F.to_json(F.struct(text.alias("response"))))
        .when(kind == 4, one("messages", role.alias("role"), F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content")))
        .otherwise(one("messages", role.alias("role"), text.alias("content")))
    )
    return df.select("conv_id", "turn", record.alias("record"))


class _Digest:
    def __init__(self, conv):
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, mask: list[dict]) -> None:
        self.chars += len(formatted)
        for role, text, _, _ in read_turns(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        for span in mask:
            text = _ESCAPED.sub(r"\1", formatted[span["start"] : span["end"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self):
        return (self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Reads formatted turns (conv_id, turn, formatted, loss_spans) back, in order of turn (ties: of the formatted text).

    The loss is what the spans of the mask hold, unescaped. Conversations stream through their task turn by turn, so that
    memory doesn't grow with their length. Rows with a null conv_id are one conversation; rows without formatted text count nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        kind = None

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for conv, text, mask in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv)
                now.add(text or "", mask or [])
            if done:
                yield flush(done)
        if now is not None:
            yield flush([now.row()])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    rows = formatted.select("conv_id", "turn", "formatted", "loss_spans")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The conversation whose texts imitate the template's marks.
HOSTILE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
