"""Chat formatting with typed content parts.

A turn's content is a list of typed parts. A visitor flattens them in order:
text stays text, images, audio and documents become placeholders that number
the attachments of their segment, and for each attachment its reference, place
and expanded token count are recorded. A turn is written as

    <turn ROLE>
    text with placeholders like <image 0></turn>

Reversible escapes: in texts a backslash goes after every ``<`` that begins a
control word (``<turn``, ``</turn``, ``<image``, ``<audio``, ``<document``,
with any number of backslashes after the ``<`` already), so a text never holds
a control string and dropping one backslash gives it back; in roles ``%``,
``<``, ``>`` and line ends are percent codes.

Turns are put in order by one range exchange on (conversation, turn), so a
conversation of any length is spread over tasks, and each task writes it as
segments of about SEGMENT_CHARS. A segment that is known to hold its whole
conversation is marked; only the others meet again when digests of whole
conversations are made, as a stream of segments in order.

Defined results: a null text or null content is empty, a null role is the
empty role, adjacent texts are one text; parts of an unknown or null kind are
documents. Turns are ordered by turn (null first), ties by role, then by a
hash of their content; repeated rows are repeated turns. Rows with a null
conversation form one conversation. An empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contingo.llm.cluster import shared_folder, small_batches

#: A segment ends after the turn with which it reaches so many code points.
SEGMENT_CHARS = 1 << 20
#: One part: which fields count depends on the kind.
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
#: Digests come in batches of so many conversations.
DIGESTS = 1000

_WORDS = r"(\\*/?(?:turn|image|audio|document)\b)"
_CONTROL = re.compile("<" + _WORDS, re.ASCII)
_ESCAPED = re.compile(r"<\\" + _WORDS, re.ASCII)
_PLACEHOLDER = re.compile(r"<(?:image|audio|document) [0-9]+>")
_ROLE_CODES = [("%", "%25"), ("<", "%3C"), (">", "%3E"), ("\n", "%0A"), ("\r", "%0D")]
_END = "</turn>\n"


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1", text) if "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1", text) if "<\\" in text else text


def escape_role(role: str) -> str:
    for plain, code in _ROLE_CODES:
        role = role.replace(plain, code)
    return role


def unescape_role(role: str) -> str:
    for plain, code in reversed(_ROLE_CODES):
        role = role.replace(code, plain)
    return role


@dataclass(frozen=True)
class Expansion:
    """Tokens that attachments stand for: image patches, audio frames, document pages; at least one each."""

    patch: int = 28
    audio_rate: float = 25.0
    page_tokens: int = 768

    def image(self, part: dict) -> int:
        return max(1, math.ceil((part["width"] or 0) / self.patch) * math.ceil((part["height"] or 0) / self.patch))

    def audio(self, part: dict) -> int:
        seconds = part["seconds"] or 0.0
        return max(1, math.ceil(seconds * self.audio_rate)) if math.isfinite(seconds) else 1

    def document(self, part: dict) -> int:
        return max(1, (part["pages"] or 0) * self.page_tokens)


@dataclass
class Flattener:
    """Visits the parts of a segment's turns and keeps what has been written so far."""

    sizes: Expansion = field(default_factory=Expansion)
    written: list[str] = field(default_factory=list)
    length: int = 0
    loss: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    n_turns: int = 0

    def write(self, text: str) -> None:
        self.written.append(text)
        self.length += len(text)

    def turn(self, role: str | None, parts: list[dict] | None, learned: bool) -> None:
        self.write(f"<turn {escape_role(role or '')}>\n")
        run: list[str] = []
        for part in [*(parts or ()), None]:
            if part is not None and part["kind"] == "text":
                run.append(part["text"] or "")
                continue
            self.visit_text("".join(run), learned)
            run = []
            if part is not None:
                getattr(self, f"visit_{part['kind']}" if part["kind"] in ("image", "audio") else "visit_document")(part)
        self.write(_END)
        self.n_turns += 1

    def visit_text(self, text: str, learned: bool) -> None:
        if text:
            start = self.length
            self.write(escape(text))
            if learned:
                self.loss.append((start, self.length))

    def visit_image(self, part: dict) -> None:
        self.attach("image", part, self.sizes.image(part))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, self.sizes.audio(part))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, self.sizes.document(part))

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        number = len(self.attachments)
        self.attachments.append({"number": number, "turn": self.n_turns, "kind": part["kind"] or kind, "ref": part["ref"],
                                 "at": self.length, "tokens": tokens})
        self.write(f"<{kind} {number}>")


def read_turns(formatted: str) -> Iterator[tuple[str, list[str]]]:
    """(role, text runs between placeholders) of each turn."""
    at = 0
    while at < len(formatted):
        body, end = formatted.index(">\n", at), formatted.index(_END, at)
        yield (unescape_role(formatted[at + len("<turn "):body]),
               [unescape(run) for run in _PLACEHOLDER.split(formatted[body + 2:end])])
        at = end + len(_END)


_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_ATTACHMENTS = pa.list_(pa.struct([("number", pa.int32()), ("turn", pa.int32()), ("kind", pa.string()), ("ref", pa.string()),
                                   ("at", pa.int64()), ("tokens", pa.int64())]))
_SEGMENT = ("place long, whole boolean, n_turns long, formatted string, loss array<struct<start:bigint,stop:bigint>>, "
            "attachments array<struct<number:int,turn:int,kind:string,ref:string,at:bigint,tokens:bigint>>")


def text_part(text: Column) -> Column:
    """Content of one text part."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), none.cast("string").alias("ref"),
                            none.cast("int").alias("width"), none.cast("int").alias("height"),
                            none.cast("double").alias("seconds"), none.cast("int").alias("pages")))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         content: str = "content", learned: tuple[str, ...] = ("assistant",),
                         sizes: Expansion = Expansion(), segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Segments of formatted conversations: conv_id, place (their order), whole (nothing of the conversation is
    elsewhere), n_turns, formatted, the loss mask's spans and the attachments, both by code points of ``formatted``."""
    small_batches(turns.sparkSession)
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"),
                        F.col(content).cast(PARTS).alias("content"))
    keys = [F.col("conv_id"), F.col("turn"), F.col("role"), F.xxhash64("content")]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        place, current, open_, seen, out = TaskContext.get().partitionId() << 32, None, None, 0, None

        def flush(whole: bool) -> pa.RecordBatch:
            nonlocal place
            place += 1
            return pa.RecordBatch.from_arrays(
                [open_["id"], pa.array([place - 1], type=pa.int64()), pa.array([whole]),
                 pa.array([out.n_turns], type=pa.int64()), pa.array(["".join(out.written)], type=pa.string()),
                 pa.array([[{"start": a, "stop": b} for a, b in out.loss]], type=_LOSS),
                 pa.array([out.attachments], type=_ATTACHMENTS)],
                ["conv_id", "place", "whole", "n_turns", "formatted", "loss", "attachments"])

        for batch in batches:
            ids, roles, contents = batch.column(0), batch.column(2).to_pylist(), batch.column(3)
            values = ids.to_pylist()
            for i in range(batch.num_rows):
                if open_ is None or values[i] != current:
                    if out is not None and out.n_turns:
                        yield flush(seen > 1 and not open_["split"])     # the task's first may have begun before it
                    current, seen = values[i], seen + 1
                    open_, out = {"id": ids.slice(i, 1), "split": False}, Flattener(sizes)
                elif out.length >= segment_chars:
                    open_["split"] = True
                    yield flush(False)
                    out = Flattener(sizes)
                out.turn(roles[i], contents[i].as_py(), roles[i] in learned)
        if out is not None and out.n_turns:
            yield flush(False)                                           # the last may go on in the next task

    return ordered.mapInArrow(segments, f"conv_id {kind}, {_SEGMENT}")


def digests(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its segments: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, n_attachments, attachment_tokens."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "attachment_tokens"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, done, current, facts = [], [], None, None

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.concat_arrays(ids), *(pa.array([d[n] for d in done], type=pa.string() if "sha" in n else pa.int64())
                                          for n in names)], ["conv_id", *names])
            ids.clear()
            done.clear()
            return out

        def close() -> None:
            done.append({**facts["n"], "turns_sha256": facts["turns"].hexdigest(), "loss_sha256": facts["loss"].hexdigest()})

        for batch in batches:
            column, values = batch.column(0), batch.column(0).to_pylist()
            for i in range(batch.num_rows):
                if facts is None or values[i] != current:
                    if facts is not None:
                        close()
                        if len(done) >= DIGESTS:
                            yield flush()
                    current = values[i]
                    ids.append(column.slice(i, 1))
                    facts = {"n": dict.fromkeys([n for n in names if "sha" not in n], 0),
                             "turns": hashlib.sha256(), "loss": hashlib.sha256()}
                text, n = batch.column(1)[i].as_py(), facts["n"]
                n["formatted_chars"] += len(text)
                for role, runs in read_turns(text):
                    n["n_turns"] += 1
                    facts["turns"].update(f"{role}\n{''.join(runs)}\n".encode())
                for span in batch.column(2)[i].as_py():
                    under = unescape(text[span["start"]:span["stop"]])
                    n["loss_chars"] += len(under)
                    facts["loss"].update(under.encode())
                for a in batch.column(3)[i].as_py():
                    n["n_attachments"] += 1
                    n["attachment_tokens"] += a["tokens"]
        if facts is not None:
            close()
            yield flush()

    shape = f"conv_id {kind}, " + ", ".join(f"{n} {'string' if 'sha' in n else 'long'}" for n in names)
    columns = ["conv_id", "formatted", "loss", "attachments"]
    alone = formatted.where("whole").select(columns)
    spread = formatted.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "place").select(columns)
    return alone.mapInArrow(read, shape).union(spread.mapInArrow(read, shape))


def op13_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    turns = rows.union(own).withColumn("content", text_part(F.coalesce("text", F.lit(""))))
    made = format_conversations(turns)
    folder = shared_folder(spark, "chat")
    made.write.parquet(folder)
    return digests(spark.read.schema(made.schema).parquet(folder))


OP13_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, '<turn ' || replace(replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '>', '%3E'), chr(10), '%0A'),
    chr(13), '%0D') || '>' || chr(10)
  || regexp_replace(text, '<(\\*/?(?:turn|image|audio|document)\b)', '<\\\1', 'g') || '</turn>' || chr(10) AS formatted FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
  CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_attachments,
  CAST(0 AS BIGINT) AS attachment_tokens
FROM f GROUP BY conv_id
"""
