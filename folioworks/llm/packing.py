"""Packing by vector bin packing with the dot-product heuristic.

Each example asks for three things: tokens, one segment, and loss-bearing tokens; a sequence has a limit on each. The
open sequence takes the example, among those that fit, whose demand has the largest dot product with what is left
(both as shares of the limits), so a scarce resource is filled by those who ask for little of the others. Each task
packs its own rows from a window of waiting examples, so memory is bounded and nothing is shuffled. Sequence ids hold
the task's number in their upper bits.

`pack_documents` may cut: a document's full sequences are cut off first, the rest are packed, and the last free tokens
of a sequence are filled by cutting a waiting rest. All tokens of a piece but the first, which nothing stands before,
bear loss. Where the waiting rests are so short that the segment limit would close a sequence early, the sequence ends
at a power of two that they do fill, so it needs no padding. `pack_examples` never cuts, as instruction data needs.

Defined cases: null text is empty; an empty document has the end id alone; repeated rows are packed as often as they
occur; an example beyond a limit gets a sequence of its own in `pack_examples`, flagged `over`. An empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm.tokens import pieces

#: Examples that wait for a place.
WINDOW = 256
_SHIFT = 40


class Packer:
    """Fills sequences under limits (tokens, segments, loss-bearing tokens).

    place(item, take, sequence, offset) is called for each piece: `take` tokens from the front of what is left of item.
    """

    def __init__(self, limits: tuple[int, int, int], place: Callable, cut: bool, first: int, window: int = WINDOW):
        self.limits, self.place, self.cut, self.window = np.array(limits, float), place, cut, window
        self.items: list = []
        self.need = np.zeros((2 * window, 3))
        self.left, self.used = self.limits.copy(), 0
        self.sequence = first

    def add(self, item, tokens: int, loss: int) -> None:
        self.need[len(self.items)] = tokens, 1, loss
        self.items.append(item)
        while len(self.items) >= self.window:  # a cut places a piece and keeps the item
            self._step()

    def _close(self) -> None:
        if self.used:
            self.sequence += 1
        self.left, self.used = self.limits.copy(), 0

    def _put(self, i: int, take: int) -> None:
        self.place(self.items[i], take, self.sequence, self.used)
        need = self.need[i]
        self.left -= take, 1, take - 1 if take < need[0] else need[2]
        self.used += take
        if take < need[0]:  # a cut: the rest is an example of its own
            need[0] -= take
            need[2] = need[0] - 1
        else:
            last = len(self.items) - 1
            self.items[i] = self.items[last]
            self.need[i] = self.need[last]
            self.items.pop()
        if (self.left < 1).any():
            self._close()

    def _aim(self, waiting: np.ndarray) -> None:
        """Lets the sequence end at a power of two if the longest waiting examples can't fill it within the segments left."""
        n = int(self.left[1])
        if not self.cut or n >= self.left[0]:  # each has a token or more
            return
        most = waiting if len(waiting) <= n else np.partition(waiting, len(waiting) - n)[-n:]
        reach = self.used + int(most.sum())
        even = 1 << (reach.bit_length() - 1)
        if reach < self.used + self.left[0] and even > self.used:
            self.left[0] = even - self.used

    def _step(self) -> None:
        """Places one example, or one piece of an example, or closes the sequence."""
        need = self.need[: len(self.items)]
        if self.cut and not int(self.left[1]) & (int(self.left[1]) - 1) or not self.used:
            self._aim(need[:, 0])
        fits = (need <= self.left).all(axis=1)
        if self.cut and self.left[1] == 1:  # the last segment must fill the sequence
            fits &= need[:, 0] == self.left[0]
        if fits.any():
            score = np.where(fits, (need / self.limits) @ (self.left / self.limits), -1.0)
            i = int(score.argmax())
            return self._put(i, int(need[i, 0]))
        if self.cut:
            i = int(need[:, 0].argmax())
            take = int(min(self.left[0], self.left[2] + 1, need[i, 0]))
            return self._put(i, take)
        if self.used:
            return self._close()
        self._put(0, int(need[0, 0]))  # beyond a limit: alone in a sequence
        self._close()

    def finish(self) -> None:
        """Places what waits. With cuts, what doesn't fill a whole sequence goes to sequences of a power of two."""
        total = int(self.limits[0])
        while self.items:
            waiting = self.need[: len(self.items), 0].sum()
            if self.cut and self.used + waiting < total:
                even = 1 << (int(self.used + waiting).bit_length() - 1)
                if even > self.used:
                    self.left[0] = even - self.used
            self._step()
        self._close()


def _pack_documents(limits: tuple[int, int, int], tokenizer: str | None, ranks: str | None, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(tokenizer, ranks)
        most = limits[0]
        out: list[tuple] = []

        def place(item: list, take: int, sequence: int, offset: int) -> None:
            doc, ids, start, total = item
            out.append((doc, start, take, zlib.crc32(ids[: 4 * take]), total, sequence, offset))
            item[1], item[2] = ids[4 * take :], start + take

        packer = Packer(limits, place, True, TaskContext.get().partitionId() << _SHIFT)

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        names, kind = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], pa.int64()
        whole = (TaskContext.get().partitionId() << _SHIFT) + (1 << (_SHIFT - 1))
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = vocabulary.ids(text.as_py() or "") + end
                total, start = len(ids) // 4, 0
                while total - start >= most:  # a full sequence of its own
                    out.append((doc, start, most, zlib.crc32(ids[4 * start : 4 * (start + most)]), total, whole, 0))
                    whole, start = whole + 1, start + most
                if start < total:
                    packer.add([doc, ids[4 * start :], start, total], total - start, total - start - 1)
                if len(out) >= 20_000:
                    yield rows()
        packer.finish()
        if out:
            yield rows()

    return run


def pack_documents(docs: DataFrame, tokens: int = 1024, segments: int = 128, loss_tokens: int = 1024, tokenizer: str | None = None,
                   ranks: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row for each piece of a document.

    tokenizer, ranks: see tokens.pieces. end_id follows each document's ids.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.mapInArrow(_pack_documents((tokens, segments, loss_tokens), tokenizer, ranks, end_id), schema).withColumnRenamed("id", id_col)


def _pack_examples(limits: tuple[int, int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        packer = Packer(limits, lambda item, take, sequence, offset: out.append((item[0], take, sequence, offset, item[1])), False,
                        TaskContext.get().partitionId() << _SHIFT)
        kind = pa.int64()

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 5
            out.clear()
            kinds = (kind, pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "length", "sequence_id", "offset", "over"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for key, n, loss in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n, loss = n or 0, loss or 0
                packer.add((key, n > limits[0] or loss > limits[2]), n, loss)
            if out:
                yield rows()
        packer.finish()
        if out:
            yield rows()

    return run


def pack_examples(examples: DataFrame, tokens: int = 1024, segments: int = 16, loss_tokens: int = 768,
                  id_col: str = "conv_id", tokens_col: str = "n_tokens", loss_col: str = "n_loss") -> DataFrame:
    """(id, length, sequence_id, offset, over): a place for each whole example of instruction data.

    Null counts are 0. over: the example alone is beyond a limit and has a sequence of its own.
    """
    examples = examples.select(F.col(id_col).alias("id"), F.col(tokens_col).cast("long"), F.col(loss_col).cast("long"))
    schema = f"id {examples.schema['id'].dataType.simpleString()}, length long, sequence_id long, offset long, over boolean"
    return examples.mapInArrow(_pack_examples((tokens, segments, loss_tokens)), schema).withColumnRenamed("id", id_col)


def _count_tokens(tokenizer: str | None, ranks: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(tokenizer, ranks)
        for batch in batches:
            n = [len(vocabulary.ids(text.as_py() or "")) // 4 for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(2)], ["id", "n", "bears"])

    return run


def conversation_examples(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), tokenizer: str | None = None, ranks: str | None = None,
                          id_col: str = "conv_id", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_loss) per conversation; the turns of `loss_roles` bear loss. Null text and null roles count as empty and as none of the roles."""
    turns = turns.select(F.col(id_col).alias("id"), F.col(text_col), F.coalesce(F.col(role_col).isin(*loss_roles), F.lit(False)).alias("bears"))
    counted = turns.mapInArrow(_count_tokens(tokenizer, ranks), f"id {turns.schema['id'].dataType.simpleString()}, n long, bears boolean")
    loss = F.sum(F.when(F.col("bears"), F.col("n")).otherwise(0))
    return counted.groupBy(F.col("id").alias(id_col)).agg(F.sum("n").alias("n_tokens"), loss.alias("n_loss"))
