"""Fill-in-middle transformation by secondary sort.

Texts are cut into a prefix, a middle and a suffix and put together anew with marks between
them. No text is put together in memory: each is emitted as pieces of at most ``UNIT`` code
points, keyed by document and by the position that the piece has in the output. One shuffle by
document, sorted within its partitions by that position, lets the pieces stream by in output
order, into a digest or a file. To restore the texts, the same stream is read for its marks,
every piece gets its position in the original, and the partitions are sorted once more, without
another shuffle.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from citeweave.llm.common import slices

#: Code points in a piece, and the marks before prefix, suffix and middle.
UNIT = 1 << 14
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Which marks a form writes, in order; the original order is that of ``MARKS`` with middle second.
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
PLACE = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}

#: What identifies a document in the stream, and a piece of it.
KEY = ("task", "doc_id", "hash")
ABOUT = ("n", "form", "prefix_chars", "middle_chars")


def draws(doc_id: Column, seed: str) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of ``seed:id``; a null id is the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def plan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", seed: str = "1", keep_plain: int = 10, suffix_first: int = 20) -> DataFrame:
    """``doc_id, text, hash`` and the decision on each document: ``n, form, prefix_chars, middle_chars``.

    Cut points are uniform over the n + 1 places between code points. ``keep_plain``
    percent of the documents stay plain, as do those that are empty or hold a mark; of
    the others ``suffix_first`` percent are written suffix first (``spm``), the rest
    prefix, suffix, middle (``psm``).
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.withColumn("n", F.length("text").cast("long")).withColumn("h", F.array(*draws(F.col("doc_id"), seed)))
    cut = [F.col("h")[k] % (F.col("n") + 1) for k in range(2)]
    marked = F.lit(False)
    for m in MARKS:
        marked = marked | F.contains("text", F.lit(m))
    plain = (F.col("n") == 0) | marked | (F.col("h")[2] % 100 >= 100 - keep_plain)
    form = F.when(plain, "plain").when(F.col("h")[3] % 100 < suffix_first, "spm").otherwise("psm")
    return d.select(
        "doc_id", "text", F.xxhash64("text").alias("hash"), "n", form.alias("form"),
        F.least(*cut).alias("first"), F.greatest(*cut).alias("second")).select(
        "doc_id", "text", "hash", "n", "form", F.when(F.col("form") != "plain", F.col("first")).alias("prefix_chars"),
        F.when(F.col("form") != "plain", F.col("second") - F.col("first")).alias("middle_chars"))


def _pieces_of(text: str, form: str, prefix: int | None, middle: int | None) -> Iterator[str]:
    """The output in pieces; a mark stands before the first piece of its part."""
    if form == "plain":
        spans = [("", 0, len(text))]
    else:
        ends = {PREFIX: (0, prefix), MIDDLE: (prefix, prefix + middle), SUFFIX: (prefix + middle, len(text))}
        spans = [(mark, *ends[mark]) for mark in ORDERS[form]]
    for mark, start, stop in spans:
        yield mark + text[start:min(start + UNIT, stop)]
        for at in range(start + UNIT, stop, UNIT):
            yield text[at:min(at + UNIT, stop)]


def arrange(docs: DataFrame, **how) -> DataFrame:
    """The outputs as pieces: ``task, doc_id, hash, n, form, prefix_chars, middle_chars, position, piece``.

    Pieces of a document lie in one partition, in output order; an empty output is one
    empty piece. A document is known by its id, the hash of its text and the task that
    emitted it, so that rows with one id, null included, are spread and a task that is run
    again emits the same keys. Rows with the same id and text in a task travel as repeated
    positions and come out as often as they went in. See ``plan`` for the options; a null
    text is empty, an empty table gives no rows, other columns are ignored.
    """
    planned = plan(docs, **how)
    planned = planned.withColumn("task", F.spark_partition_id())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, position, pieces = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("text", *ABOUT[1:])]
            for i, (text, form, prefix, middle) in enumerate(zip(*columns, strict=True)):
                for k, piece in enumerate(_pieces_of(text, form, prefix, middle)):
                    rows.append(i)
                    position.append(k)
                    pieces.append(piece)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(take) for c in (*KEY, *ABOUT)], pa.array(position, pa.int64()), pa.array(pieces, pa.string())],
                [*KEY, *ABOUT, "position", "piece"])

    schema = planned.select(*KEY, *ABOUT).schema.add("position", "long").add("piece", "string")
    return planned.mapInArrow(emit, schema).repartition(*KEY).sortWithinPartitions(*KEY, "position")


class Marks:
    """Reads an output piece by piece and tells which part of the original each stretch of it is."""

    def __init__(self, form: str) -> None:
        self.due = list(ORDERS.get(form, ()))
        self.part = None if self.due else PREFIX
        self.held = ""

    def place(self) -> int:
        if self.part is None:
            raise ValueError("an output must begin with the mark of its form")
        return PLACE[self.part]

    def feed(self, piece: str) -> Iterator[tuple[int, str]]:
        """(place in the original, stretch) of what is certain; the start of a mark is held back."""
        text = self.held + piece
        self.held = ""
        while self.due:
            at = text.find(self.due[0])
            if at < 0:
                hold = next((k for k in (2, 1) if text.endswith(self.due[0][:k])), 0)
                text, self.held = text[:len(text) - hold], text[len(text) - hold:]
                break
            if at:
                yield self.place(), text[:at]
            text = text[at + len(self.due[0]):]
            self.part = self.due.pop(0)
        if text:
            yield self.place(), text

    def close(self) -> Iterator[tuple[int, str]]:
        """What was held back at the end."""
        if self.held:
            yield self.place(), self.held
            self.held = ""


def _rows(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in slices(batches):
        yield from zip(*[batch.column(c).to_pylist() for c in columns], strict=True)


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 1000) -> Iterator[pa.RecordBatch]:
    while part := list(itertools.islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*part, strict=True), schema, strict=True)], schema.names)


class _Once:
    """The pieces of one document, each position once; ``copies`` tells how many equal rows travel together."""

    def __init__(self, rows: Iterator[tuple], spot: slice) -> None:
        self.rows, self.spot, self.copies = rows, spot, 0

    def __iter__(self) -> Iterator[tuple]:
        first = last = None
        for row in self.rows:
            here = row[self.spot]
            first = here if first is None else first
            self.copies += here == first
            if here != last:
                yield row
            last = here


def restore(pieces: DataFrame) -> DataFrame:
    """The originals as pieces, rebuilt from the outputs that ``arrange`` streams and their forms alone.

    ``task, doc_id, hash, n, form, prefix_chars, middle_chars, place, position, piece,
    output_sha256``, sorted by document and place in the original. Each document ends
    with an empty piece that carries the lowercase-hex SHA-256 of its output.
    """
    head = [*KEY, *ABOUT]
    schema = pieces.select(*head).schema.add("place", "integer").add("position", "long").add("piece", "string").add("output_sha256", "string")
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, rows in itertools.groupby(_rows(batches, [*head, "position", "piece"]), key=lambda row: row[:len(KEY)]):
            digest, marks, k, about = hashlib.sha256(), None, 0, ()
            document = _Once(rows, slice(len(head), len(head) + 1))
            for row in document:
                about, piece = row[:len(head)], row[-1]
                marks = marks or Marks(about[head.index("form")])
                digest.update(piece.encode("utf-8"))
                for place, stretch in marks.feed(piece):
                    yield (*about, place, k, stretch, None)
                    k += 1
            for place, stretch in marks.close():
                yield (*about, place, k, stretch, None)
            for _ in range(document.copies):
                yield (*about, len(PLACE), 0, "", digest.hexdigest())

    ordered = pieces.mapInArrow(lambda batches: _batched(read(batches), arrow), schema)
    return ordered.sortWithinPartitions(*KEY, "place", "position")


def digests(restored: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``, a row for each document.

    Both digests are of UTF-8 bytes in lowercase hex and are fed piece by piece.
    """
    head = ["doc_id", *ABOUT]
    schema = restored.select(*head, "output_sha256").schema.add("restored_sha256", "string")
    arrow = to_arrow_schema(schema)
    columns = [*KEY, *ABOUT, "piece", "output_sha256"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for key, rows in itertools.groupby(_rows(batches, columns), key=lambda row: row[:len(KEY)]):
            digest = hashlib.sha256()
            for row in rows:
                if row[-1] is None:
                    digest.update(row[-2].encode("utf-8"))
                else:
                    yield (key[KEY.index("doc_id")], *row[len(KEY):-2], row[-1], digest.hexdigest())

    return restored.mapInArrow(lambda batches: _batched(read(batches), arrow), schema)


def joined(pieces: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: the outputs of ``arrange`` as whole texts."""
    head = [*KEY, *ABOUT]
    schema = pieces.select("doc_id", *ABOUT).schema.add("output", "string")
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, rows in itertools.groupby(_rows(batches, [*head, "position", "piece"]), key=lambda row: row[:len(KEY)]):
            document = _Once(rows, slice(len(head), len(head) + 1))
            parts, about = [], ()
            for row in document:
                about = row[:len(head)]
                parts.append(row[-1])
            for _ in range(document.copies):
                yield (about[KEY.index("doc_id")], *about[len(KEY):], "".join(parts))

    return pieces.mapInArrow(lambda batches: _batched(read(batches), arrow), schema)
