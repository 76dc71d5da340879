"""Chat formatting: schema fingerprints select declarative mappings from heterogeneous layouts to canonical turns.

A record's fingerprint is the hash of its sorted nested field paths. MAPPINGS declares layouts by the paths that they need;
the first that fits is remembered for the fingerprint. It yields turns (role, text), which one template writes as

    <|im_start|>role\\n text <|im_end|>\\n          (without the blanks)

Control strings inside texts are escaped reversibly: backslashes are doubled, and a single one is put behind the first character
of each control string. The loss mask is a span of each assistant turn: its text. A conversation is the concatenation of
its segments, one for each turn, which are rows: a very long conversation is not held in memory.

Null texts are empty, null roles have an empty name. Turns are ordered by number (nulls last), those of one
number by their formatted segments; repeated rows stay. Records of no known layout give no turns and one row with layout "unknown". Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.llm.common import partitions, staged

# Strings that some chat template reads as control.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
# Names of roles in the layouts, and the canonical ones.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

# Layouts: the paths that a record needs; then either `list` with role and text inside, or `fields` as (path, role) in order.
# Names of roles are made canonical, but for layouts that say as_is: their roles are canonical already.
MAPPINGS = [
    {"name": "row", "needs": ["role", "text", "turn"], "fields": [("text", "@role")], "as_is": True},
    {"name": "messages", "needs": ["messages[].content", "messages[].role"], "list": "messages", "role": "role", "text": "content"},
    {"name": "conversations", "needs": ["conversations[].from", "conversations[].value"], "list": "conversations", "role": "from", "text": "value"},
    {"name": "turns", "needs": ["turns[].role", "turns[].text"], "list": "turns", "role": "role", "text": "text"},
    {"name": "instruction_input", "needs": ["input", "instruction", "output"], "fields": [("instruction+input", "user"), ("output", "assistant")]},
    {"name": "instruction", "needs": ["instruction", "output"], "fields": [("instruction", "user"), ("output", "assistant")]},
    {"name": "instruction_response", "needs": ["instruction", "response"], "fields": [("instruction", "user"), ("response", "assistant")]},
    {"name": "prompt_completion", "needs": ["completion", "prompt"], "fields": [("prompt", "user"), ("completion", "assistant")]},
    {"name": "prompt_response", "needs": ["prompt", "response"], "fields": [("prompt", "user"), ("response", "assistant")]},
    {"name": "question_answer", "needs": ["answer", "question"], "fields": [("question", "user"), ("answer", "assistant")]},
]


def paths(value, at: str = "") -> set[str]:
    """Nested field paths; items of lists share one path."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def mapping_of(found: set[str]) -> dict | None:
    return next((m for m in MAPPINGS if found.issuperset(m["needs"])), None)


def turns_of(record: dict, mapping: dict) -> list[tuple[str, str]]:
    """Canonical turns of a record."""
    if "list" in mapping:
        pairs = [(t.get(mapping["role"]), t.get(mapping["text"])) for t in record[mapping["list"]]]
    else:
        pairs = []
        if record.get("system") is not None:
            pairs.append(("system", record["system"]))
        for field, role in mapping["fields"]:
            text = "\n".join(str(record[f]) for f in field.split("+") if record.get(f) is not None and (f == field or record[f] != ""))
            pairs.append((record.get(role[1:]) if role[0] == "@" else role, text))
    names = {} if mapping.get("as_is") else ROLES
    return [(names.get(r, r) or "", "" if t is None else str(t)) for r, t in pairs]


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """A turn by the template, and the span of its text."""
    head, body = f"<|im_start|>{quote(role, safe='')}\n", escape(text)
    return f"{head}{body}<|im_end|>\n", len(head), len(head) + len(body)


SEGMENTS = "conv_id long, turn long, part int, layout string, fingerprint string, formatted string, loss_begin long, loss_end long"


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[frozenset, tuple[str, dict | None]] = {}
    for batch in batches:
        out = []
        for conv, turn, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "record")), strict=True):
            try:
                record = json.loads(text or "")
            except ValueError:
                record = None
            found = frozenset(paths(record)) if isinstance(record, dict) else frozenset()
            if found not in known:
                if len(known) > 10_000:
                    known.clear()
                known[found] = fingerprint(set(found)), mapping_of(set(found))
            mark, mapping = known[found]
            if not mapping:
                out.append((conv, turn, 0, "unknown", mark, "", 0, 0))
            for i, (role, said) in enumerate(turns_of(record, mapping) if mapping else []):
                formatted, a, b = segment(role, said)
                out.append((conv, turn, i, mapping["name"], mark, formatted, *((a, b) if role == "assistant" else (0, 0))))
        types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in SEGMENTS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)


def format_records(records: DataFrame) -> DataFrame:
    """records(conv_id, turn, record as JSON) to SEGMENTS; turn orders the records of one conversation, and may be null."""
    return records.select("conv_id", "turn", "record").mapInArrow(_format, SEGMENTS)


def row_records(rows: DataFrame) -> DataFrame:
    """A table of one turn a row, as records."""
    own = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("turn", F.lit(0)).alias("turn"))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.to_json(own).alias("record"))


class _Reader:
    """Reads the segments of one conversation one after the other."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.chars, self.loss_chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, begin: int, end: int) -> None:
        for m in _TURN.finditer(formatted):
            self.all.update(f"{unquote(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
            self.turns += 1
        masked = unescape(formatted[begin:end])
        self.loss.update(masked.encode("utf-8", "surrogatepass"))
        self.loss_chars += len(masked)
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
    now, done = None, []
    for batch in batches:
        for conv, formatted, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_begin", "loss_end")), strict=True):
            if now is None or now.conv != conv:
                if now:
                    done.append(now.row())
                now = _Reader(conv)
            now.add(formatted, a, b)
        if done:
            yield pack(done)
            done = []
    if now:
        yield pack([now.row()])


def read_back(segments: DataFrame) -> DataFrame:
    """DIGESTS of every conversation, from written segments, streamed in order: no conversation is held whole."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("part"), F.col("formatted")]
    ordered = segments.repartition(partitions(segments.sparkSession), "conv_id").sortWithinPartitions(*order)
    return ordered.select("conv_id", "formatted", "loss_begin", "loss_end").mapInArrow(_read, DIGESTS)


def format_rows(rows: DataFrame) -> DataFrame:
    """DIGESTS of a table of one turn a row, read back from its written segments."""
    return read_back(staged(format_records(row_records(rows)), "segments"))
