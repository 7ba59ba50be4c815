"""Quality rules by compression bands (op3).

After the base rules, zstandard ratios (raw bytes over compressed bytes) of the whole text and
of fixed chunks are held against limits for their length: a ratio above its band is repetitive,
one below is incompressible. A text is rejected if its whole ratio is out of band, or more than
BAD_CHUNKS of its chunks are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemill.llm.common import arrow_map, table

WHITE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
CHUNK = 4096
BAD_CHUNKS = 0.25
#: (length in bytes below which the band holds, least ratio, greatest ratio). The least ratios lie above those measured
#: of random base64 words: of 2-3 characters and longer, and below 200 bytes, where 50 words are shorter, of 1-2.
BANDS = [(100, 1.12, 2.5), (150, 1.24, 2.5), (200, 1.31, 2.5), (400, 1.31, 3.0), (600, 1.38, 3.5), (1000, 1.45, 3.5), (2000, 1.58, 4.0), (4000, 1.7, 4.0), (20000, 1.75, 4.5),
         (float("inf"), 1.8, 5.5)]
SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
          "ratio double, n_chunks long, n_bad_chunks long")


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(names.__getitem__, words), np.int64, n)
    k = len(names)
    pair = ids[:-2] * k + ids[1:-1]
    if k >= 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair * k + ids[2:]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.searchsorted(twice, key)
    at[at == len(twice)] = 0
    hit = twice[at] == key
    covered = np.zeros(n, bool)
    for d in range(3):
        covered[d:n - 2 + d] |= hit
    return int(covered.sum())


def in_band(size: int, packed: int) -> bool:
    ratio = size / packed
    for below, low, high in BANDS:
        if size < below:
            return low <= ratio <= high
    return False


def chunks(data: bytes, size: int = CHUNK) -> list[bytes]:
    """Fixed chunks; a last one under half the size belongs to its neighbour."""
    starts = list(range(0, len(data), size))
    if len(starts) > 1 and len(data) - starts[-1] < size // 2:
        starts.pop()
    return [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)])]


class Bands:
    def __init__(self, level: int = 3):
        import zstandard

        self.zip = zstandard.ZstdCompressor(level=level)

    def measure(self, data: bytes) -> tuple[bool, float, int, int]:
        """(verdict, whole ratio, chunks, chunks out of band)."""
        if not data:
            return True, 0.0, 0, 0
        size = len(self.zip.compress(data))
        parts = chunks(data)
        bad = 0
        if len(parts) > 1:
            bad = sum(not in_band(len(p), len(self.zip.compress(p))) for p in parts)
        return in_band(len(data), size) and bad <= BAD_CHUNKS * len(parts), len(data) / size, len(parts), bad


def measure(text: str | None, bands: Bands) -> tuple:
    text = text or ""
    data = text.encode()
    words = data.split()
    n = len(words)
    word_chars = len(text) - (len(data) - len(data.translate(None, WHITE)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip()]
    repeats = repeat_words(words)
    failed = n < 50 or 100 * repeats > 50 * n
    verdict, ratio, parts, bad = bands.measure(data)
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeats, failed, verdict and not failed, ratio, parts, bad


def measure_batches(batches):
    bands = Bands()
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
    for batch in batches:
        rows = [measure(t, bands) for t in batch.column("text").to_pylist()]
        cols = list(zip(*rows)) or [()] * 10
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)


def measures(documents: DataFrame) -> DataFrame:
    """The rules' counts and verdict for every row.

    A null or empty text has no words and fails the base rules. Rows with the same doc_id each
    give a row; other columns are ignored. No shuffle.
    """
    return arrow_map(documents.select("doc_id", "text"), "tidemill.llm.quality:measure_batches", SCHEMA)


def keep_batches(batches):
    bands = Bands()
    for batch in batches:
        yield batch.filter(pa.array([measure(t, bands)[6] for t in batch.column("text").to_pylist()], pa.bool_()))


def keep(documents: DataFrame) -> DataFrame:
    """The rows whose text passes, with all their columns; no join and no shuffle."""
    return arrow_map(documents, "tidemill.llm.quality:keep_batches", documents.schema)


def query(spark, sf_dir):
    return measures(table(spark, sf_dir, "documents"))
