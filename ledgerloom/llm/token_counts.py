"""Token counts by a two-tier lookup on the map side.

A piece model that never merges across "non-space, space" can be counted pre-token by pre-token. Pass one finds
frequent pre-tokens with bounded per-task summaries; their lengths, computed by the library itself, are broadcast
as a compact table whose size is bounded by a parameter. Pass two adds lengths up; misses go through a cache of
the Python worker. No pre-token is shuffled, only the per-task summaries are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows of the broadcast table: its proven size bound (an entry has at most LONGEST characters).
TABLE_ROWS = 16_384
#: Frequent pre-tokens that a task reports, and how many it follows at once.
TASK_REPORTS, TASK_FOLLOWS = 4_096, 65_536
#: Longer pre-tokens are neither tabled nor cached.
LONGEST = 48
#: Entries of a worker's cache.
CACHE_ROWS = 300_000

_PRE = re.compile(r" *[^ \n]+| +|\n")
_counters: dict[str, PieceCounter] = {}


class PieceCounter:
    """Exact token counts of pre-tokens under a piece model or tokenizer file."""

    def __init__(self, path: str):
        self.path, self.cache = path, {}
        common.one_thread()
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
            # a newline put before a pre-token takes the place of the prefix that the library would add
            self.guard = len(self.model.encode("\n"))
            self.splits = (
                not any(re.search("[^▁]▁", p) or "\n" in p for p in pieces)
                and self.model.normalize("  \ufb01\u2460") == "▁▁▁\ufb01\u2460"  # characters stay as they are
                and not any(self.model.is_unused(i) for i in range(len(pieces)))
            )
        else:
            import tokenizers

            self.model, self.splits = tokenizers.Tokenizer.from_file(path), False

    def whole(self, texts: list[str]) -> list[int]:
        """Counts of whole texts, straight from the library."""
        if self.path.endswith(".model"):
            return [len(x) for x in self.model.encode(texts, num_threads=1)] if texts else []
        return [len(x) for x in self.model.encode_batch(texts, add_special_tokens=False)] if texts else []

    def pre_tokens(self, text: str) -> list[str]:
        return _PRE.findall(" " + text.replace("▁", " ")) if text else []

    def lengths(self, pre: list[str]) -> list[int]:
        return [len(x) - self.guard for x in self.model.encode(["\n" + p for p in pre], num_threads=1)] if pre else []

    def counts(self, texts: list[str], table: dict[str, int]) -> list[int]:
        if not self.splits:
            return self.whole(texts)
        out = []
        for text in texts:
            total, misses = 0, []
            for p in self.pre_tokens(text):
                n = table.get(p)
                if n is None:
                    misses.append(p)
                else:
                    total += n
            out.append(total + self._missed(misses))
        return out

    def _missed(self, pre: list[str]) -> int:
        new = list({p for p in pre if p not in self.cache})
        if len(self.cache) + len(new) > CACHE_ROWS:
            self.cache.clear()
            new = list(set(pre))
        got = dict(zip(new, self.lengths(new), strict=True))
        self.cache.update((p, n) for p, n in got.items() if len(p) <= LONGEST)
        return sum(got[p] if p in got else self.cache[p] for p in pre)


def counter(path: str) -> PieceCounter:
    """One for each worker and file."""
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def frequent_pre_tokens(docs: DataFrame, path: str, rows: int = TABLE_ROWS) -> dict[str, int]:
    """Lengths of about the `rows` most frequent pre-tokens of all texts. Only per-task summaries are shuffled."""

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = counter(path), Counter()
        for batch in batches:
            for part in common.slices(batch):
                for text in common.texts_of(part):
                    seen.update(own.pre_tokens(text))
                if len(seen) > TASK_FOLLOWS:
                    seen = Counter(dict(seen.most_common(TASK_FOLLOWS // 2)))
        top = [(w, n) for w, n in seen.most_common(TASK_REPORTS) if len(w) <= LONGEST and n > 1]
        yield pa.RecordBatch.from_pydict({"pre": pa.array([w for w, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    if not counter(path).splits:
        return {}
    top = docs.select("text").mapInArrow(summaries, "pre string, n long").groupBy("pre").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pre").limit(rows)
    pre = [r.pre for r in top.collect()]
    return dict(zip(pre, counter(path).lengths(pre), strict=True))


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, table_rows: int = TABLE_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs; columns other than doc_id and text are ignored.

    Null texts count as empty: 0 bytes, 0 tokens. Null ids and repeated rows give a row each. An empty table gives
    no rows. Special strings inside texts are handled as the library does by default.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_pre_tokens(docs, path, table_rows))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for part in common.slices(batch):
                n = own.counts(common.texts_of(part), table.value)
                size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
