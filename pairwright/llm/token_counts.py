"""Token counts of documents, and delta-maintained rollups of them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.llm import textscan as ts
from pairwright.llm.tokens import byte_tokenizer, rank_merges, word_tokenizer

KEY = ["source", "lang", "tokenizer"]
TOTALS = T.StructType([*(T.StructField(k, T.StringType()) for k in KEY), T.StructField("docs", T.LongType()), T.StructField("tokens", T.LongType())])
#: Bytes of texts that are tokenised together.
TOGETHER = 4 << 20


def count_tokens(docs: DataFrame, words: str, ranks: str, pattern: str) -> DataFrame:
    """`docs` with two more columns: `word_tokens` by the tokenizers file `words`, `byte_tokens` by the rank file `ranks` split by `pattern`.

    Counts cover whole texts, without special tokens at their ends; where a text spells one, the tokenizers file
    decides, and in the rank file it is ordinary text.  Null and empty texts have none.  The
    files must be on every machine.  One narrow pass, no shuffle; columns of these two names are replaced.
    """
    by_rank = rank_merges(words)
    docs = docs.drop("word_tokens", "byte_tokens")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = word_tokenizer(words, by_rank), byte_tokenizer(ranks, pattern)
        for batch in batches:
            text = batch.column(names.index("text"))
            counts: tuple[list, list] = ([], [])
            for i, j in ts.slices(ts.text_bytes(text)[1], TOGETHER):
                texts = text.slice(i, j - i)
                counts[0].extend((np.diff(first.encode_column(texts)[1]) // first.width).tolist())
                counts[1].extend(second.count([t or "" for t in texts.to_pylist()]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in counts)], [*names, "word_tokens", "byte_tokens"])

    more = [T.StructField("word_tokens", T.LongType()), T.StructField("byte_tokens", T.LongType())]
    return docs.mapInArrow(ts.tidied(run), T.StructType([*docs.schema.fields, *more]))


def deltas(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """Signed rows (source, lang, tokenizer, docs, tokens) that lead from one set of counts to another.

    Rows have source, lang, tokenizer, tokens; other columns are ignored.  An insert has only `after`, a delete only
    `before`, a revision both.  A null count is 0; null keys are a group of their own.
    """
    parts = [df.select(*KEY, F.lit(sign).cast("long").alias("docs"), (F.coalesce(F.col("tokens"), F.lit(0)) * sign).cast("long").alias("tokens")) for df, sign in ((before, -1), (after, 1)) if df is not None]
    if not parts:
        raise ValueError("a delta needs rows before or after")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


class Rollup:
    """Additive totals by source, language and tokenizer version, kept as one small table per batch.

    `commit` aggregates a batch's signed rows, writes them to a folder of its own and renames
    that to `batch=<id>`, which fails if the name is taken: of several writers of a batch, or of
    a writer and its retry, exactly one succeeds, and what a crash leaves behind is never
    read.  Each batch has a digest of its sums beside it, so that a replay changes
    nothing and other rows under a known id are an error.  Totals are the sum of all batches.

    `compact` sums all batches into one table `merged=<k>` with the list of their ids, again by
    renaming; readers take the last such table and the batches that it doesn't list, so a
    crash at any point counts nothing twice.  Folders that the merge made useless go with the next one,
    when no reader looks at them any more.

    Sizes depend on the number of keys and batches, not on the number of documents; sums
    combine map-side, so hot keys are no matter.  The folder must be on a file system
    whose rename is atomic.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jsparkSession.sessionState().newHadoopConf()
        self.fs = self._hadoop(self.path).getFileSystem(hadoop)
        self.files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), hadoop)

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _list(self, prefix: str) -> list[str]:
        if not self.fs.exists(self._hadoop(self.path)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._hadoop(self.path))]
        return sorted(n[len(prefix) :] for n in names if n.startswith(prefix))

    def _note(self, path: str, value) -> None:
        out = self.fs.create(self._hadoop(path))
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def _noted(self, path: str):
        stream = self.fs.open(self._hadoop(path))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, temporary: str, name: str) -> bool:
        """Rename; False if the name is taken."""
        gateway = self.spark.sparkContext._gateway
        options = gateway.new_array(getattr(gateway.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self.files.rename(self._hadoop(temporary), self._hadoop(f"{self.path}/{name}"), options)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception.getClass().getName()):
                raise
            self.fs.delete(self._hadoop(temporary), True)
            return False

    def _merged(self) -> tuple[int, dict[str, str]]:
        """(number of the last merge, digests of the batches in it by id)."""
        last = max((int(k) for k in self._list("merged=")), default=0)
        return last, self._noted(f"{self.path}/merged={last}/_batches") if last else {}

    def committed(self) -> list[str]:
        return sorted(self._merged()[1].keys() | set(self._list("batch=")))

    def _digest(self, batch: str) -> str:
        known = self._merged()[1]
        return known[batch] if batch in known else self._noted(f"{self.path}/batch={batch}/_digest")

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Apply a batch once.  False if it had been applied before; ValueError if it then had other sums."""
        if not batch or not all(c.isalnum() or c in "-_." for c in batch):
            raise ValueError(f"not a batch id: {batch!r}")
        temporary = f"{self.path}/_new-{uuid.uuid4().hex}"
        rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(temporary)
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in TOTALS.names] + [F.col(k).isNull().cast("string") for k in KEY]
        row = F.conv(F.substring(F.sha2(F.concat_ws("\0", *cells), 256), 1, 15), 16, 10).cast("decimal(38,0)")
        n, total = self.spark.read.schema(TOTALS).parquet(temporary).agg(F.count(F.lit(1)), F.sum(row)).first()
        digest = f"{n}:{total or 0}"
        self._note(f"{temporary}/_digest", digest)
        done = batch not in self._merged()[1] and self._publish(temporary, f"batch={batch}")
        if not done:
            self.fs.delete(self._hadoop(temporary), True)
            if self._digest(batch) != digest:
                raise ValueError(f"batch {batch!r} was applied with other rows")
        return done

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens); keys whose documents are all gone are left out."""
        return self._sums().filter("docs <> 0 or tokens <> 0")

    def _sums(self) -> DataFrame:
        last, listed = self._merged()
        paths = [f"{self.path}/merged={last}"] * bool(last) + [f"{self.path}/batch={b}" for b in self._list("batch=") if b not in listed]
        rows = self.spark.read.schema(TOTALS).parquet(*paths) if paths else self.spark.createDataFrame([], TOTALS)
        return rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def compact(self) -> bool:
        """Sum all batches into one table.  False if another writer did so meanwhile, or if there is nothing to merge."""
        last, listed = self._merged()
        new = [b for b in self._list("batch=") if b not in listed]
        old = [f"batch={b}" for b in self._list("batch=") if b in listed] + [f"merged={k}" for k in self._list("merged=") if int(k) < last]
        if not new:
            return False
        temporary = f"{self.path}/_new-{uuid.uuid4().hex}"
        paths = [f"{self.path}/merged={last}"] * bool(last) + [f"{self.path}/batch={b}" for b in new]
        rows = self.spark.read.schema(TOTALS).parquet(*paths).groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        rows.filter("docs <> 0 or tokens <> 0").write.parquet(temporary)
        self._note(f"{temporary}/_batches", listed | {b: self._noted(f"{self.path}/batch={b}/_digest") for b in new})
        if not self._publish(temporary, f"merged={last + 1}"):
            return False
        for name in old:  # useless since the merge before
            self.fs.delete(self._hadoop(f"{self.path}/{name}"), True)
        return True
