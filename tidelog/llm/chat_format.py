"""Chat formatting at token level.

Every role and text is encoded alone; reserved ids, which no text can produce, are spliced between the segments:

    TURN role TEXT text END            one turn
    <|turn|>role<|text|>text<|end|>    the same as text

The loss mask covers the ids of assistant texts and nothing else. It is derived from prefix sums of the segment
lengths: of the segments within a turn, then of the turns within a conversation.

Control strings that occur in content are escaped reversibly: an ESCAPE goes after their first character, and one
more for each that is there already. Every control string begins with < or [, ends with > or ] and holds neither
in between, so two of them never overlap and `unescape` takes back exactly what `escape` put in. Other text is
left as it is.

Defined results
---------------
- null role or text: empty. Empty texts make a turn without text ids.
- null conv_id: one conversation with the id null. null turn: before the numbered turns.
- ties (the same conv_id and turn) and repeated rows: all are turns, ordered by turn, then by their ids.
- very long texts or conversations: turns are formatted one by one; `assemble` streams over sorted turns and holds
  one Arrow batch at a time, whatever a conversation's length.
- empty table: no rows. Extra columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, spans, text_of
from .encoding import decoder, encoder, tokenizer

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"

#: The control strings of this and of other common templates.
CONTROL = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>", "<pad>", "<unk>")

ESCAPE = "\\"
_FIND = re.compile("|".join(f"{re.escape(c[0])}{re.escape(ESCAPE)}*{re.escape(c[1:])}" for c in CONTROL))
_BACK = re.compile("|".join(f"{re.escape(c[0])}{re.escape(ESCAPE)}+{re.escape(c[1:])}" for c in CONTROL))

ASSISTANT = "assistant"


def escape(text: str) -> str:
    if "<" not in text and "[" not in text:
        return text
    return _FIND.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    if ESCAPE not in text:
        return text
    return _BACK.sub(lambda m: m[0][0] + m[0][2:], text)


def reserved(path: str) -> tuple[int, int, int]:
    """Ids of TURN, TEXT and END: the first three after the vocabulary."""
    n = tokenizer(path).get_vocab_size(with_added_tokens=True)
    return n, n + 1, n + 2


TURNS = "conv_id bigint, turn bigint, ids array<int>, loss_from int, loss_to int, formatted_chars bigint, formatted string"


def format_turns(turns: DataFrame, vocabulary: str, as_text: bool = True) -> DataFrame:
    """One row per turn: its ids, the span of ids under the loss mask (empty but for assistants), how many characters it
    has as text, and with as_text that text."""
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("ids", pa.list_(pa.int32())), ("loss_from", pa.int32()), ("loss_to", pa.int32()), ("formatted_chars", pa.int64()), ("formatted", pa.string())])
    marks = len(TURN) + len(TEXT) + len(END)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, (turn_id, text_id, end_id) = encoder(vocabulary), reserved(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                n = b.num_rows
                roles, texts = ([escape(x) for x in b.column(k).to_pylist()] for k in (2, 3))
                codes, sizes = enc.encode(pa.array([*roles, *texts], pa.string()))
                heads = np.cumsum(sizes) - sizes
                role_n, text_n = sizes[:n], sizes[n:]
                # Prefix sums of the segments' lengths: where each turn begins, and its text.
                ends = np.cumsum(role_n + text_n + 3)
                start = ends - (role_n + text_n + 3)
                flat = np.empty(int(ends[-1]), np.int32)
                flat[start], flat[start + 1 + role_n], flat[ends - 1] = turn_id, text_id, end_id
                flat[spans(start + 1, role_n)] = codes[spans(heads[:n], role_n)]
                flat[spans(start + 2 + role_n, text_n)] = codes[spans(heads[n:], text_n)]
                lo = 2 + role_n
                hi = np.where(np.array([r == ASSISTANT for r in roles], bool), lo + text_n, lo)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
                chars = [marks + len(r) + len(x) for r, x in zip(roles, texts, strict=True)]
                text = [f"{TURN}{r}{TEXT}{x}{END}" for r, x in zip(roles, texts, strict=True)] if as_text else pa.nulls(n, pa.string())
                yield batch_of(schema, b.column(0), b.column(1), ids, lo.astype(np.int32), hi.astype(np.int32), chars, text)

    rows = turns.select(turns["conv_id"].cast("bigint").alias("conv_id"), turns["turn"].cast("bigint").alias("turn"), text_of(turns, "role").alias("role"), text_of(turns, "text").alias("text"))
    return rows.mapInArrow(run, TURNS)


SPANS = "conv_id bigint, turn bigint, ids array<int>, start bigint, loss_from bigint, loss_to bigint, formatted_chars bigint, formatted string"


def assemble(formatted: DataFrame) -> DataFrame:
    """The turns of each conversation in order, with spans as positions in the whole conversation's ids.

    The rows of a conversation stand together and in order within a partition; they are streamed, not gathered.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("ids", pa.list_(pa.int32())), ("start", pa.int64()), ("loss_from", pa.int64()), ("loss_to", pa.int64()), ("formatted_chars", pa.int64()), ("formatted", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, at = object(), 0
        for b in batches:
            starts = []
            for c, n in zip(b.column("conv_id").to_pylist(), b.column("ids").value_lengths().to_pylist(), strict=True):
                if c != conv:
                    conv, at = c, 0
                starts.append(at)
                at += n
            s = np.array(starts, np.int64)
            yield batch_of(schema, b.column("conv_id"), b.column("turn"), b.column("ids"), s, s + b.column("loss_from").to_numpy(), s + b.column("loss_to").to_numpy(), b.column("formatted_chars"), b.column("formatted"))

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "ids")
    return ordered.mapInArrow(run, SPANS)


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def digests(assembled: DataFrame, vocabulary: str) -> DataFrame:
    """Per conversation what `assemble` made, read back: roles and texts are decoded from the ids between reserved
    ids, and the loss text is cut from them by the mask."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec, (turn_id, text_id, end_id) = decoder(vocabulary), reserved(vocabulary)
        conv, now, done = None, None, []

        def close():
            if now is not None:
                done.append((conv, now["turns"], now["all"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["formatted"]))

        for b in batches:
            ids = b.column("ids")
            n = ids.value_lengths().to_numpy().astype(np.int64)
            flat = ids.flatten().to_numpy()
            ends = np.cumsum(n)
            first = ends - n
            mid = np.flatnonzero(flat == text_id)
            if len(mid) != len(n) or (flat[first] != turn_id).any() or (flat[ends - 1] != end_id).any():
                raise ValueError("a turn's ids don't stand between the reserved ids")
            start = b.column("start").to_numpy()
            lo, hi = (first + b.column(c).to_numpy() - start for c in ("loss_from", "loss_to"))
            # Per turn: role, text before the mask, text under it, text after it.
            masked = lo < hi
            lo, hi = np.where(masked, lo, mid + 1), np.where(masked, hi, mid + 1)
            cuts = np.stack([first + 1, mid, mid + 1, lo, lo, hi, hi, ends - 1], 1).reshape(-1, 2)
            size = cuts[:, 1] - cuts[:, 0]
            read = dec.texts(flat[spans(cuts[:, 0], size)], np.concatenate([[0], np.cumsum(size)]))
            for k, (c, chars) in enumerate(zip(b.column("conv_id").to_pylist(), b.column("formatted_chars").to_pylist(), strict=True)):
                if now is None or c != conv:
                    close()
                    conv = c
                    now = {"turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0}
                role, before, under, after = read[4 * k : 4 * k + 4]
                text = unescape(before + under + after)
                loss = text if under and not before and not after else unescape(under)
                now["turns"] += 1
                now["all"].update(f"{unescape(role)}\n{text}\n".encode())
                now["chars"] += len(loss)
                now["loss"].update(loss.encode())
                now["formatted"] += chars
            if len(done) >= 1000:
                yield batch_of(schema, *zip(*done, strict=True))
                done = []
        close()
        if done:
            yield batch_of(schema, *zip(*done, strict=True))

    return assembled.mapInArrow(run, DIGESTS)


def chat_digests(turns: DataFrame, vocabulary: str) -> DataFrame:
    """The digests of what is formatted; only ids and lengths are dealt, no text."""
    return digests(assemble(format_turns(turns, vocabulary, as_text=False)), vocabulary)


def with_probe(turns: DataFrame) -> DataFrame:
    """turns plus conversation -7, whose texts are made of control strings."""
    rows = [(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", ASSISTANT))]
    own = turns.select(turns["conv_id"].cast("bigint").alias("conv_id"), turns["turn"].cast("bigint").alias("turn"), F.col("role"), F.col("text"))
    return own.unionByName(turns.sparkSession.createDataFrame(rows, own.schema))
