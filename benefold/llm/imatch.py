"""Document fingerprints: I-Match with randomised lexicons.

The lexicon holds the terms whose document frequency lies in a band (an inverse-document-frequency band; counts over all
documents). Several subsets of it are drawn at random, at rates from one in four to one in some thousands, so that short and long
texts have subsets in which they keep a few terms. A fingerprint has, for each subset, a hash of the text's distinct terms
in it, in sorted order, or zeros where it has none. The likeness of two fingerprints is the share of equal hashes among the subsets
in which either has terms, at the rates that don't nearly always have some.

The lexicon is bounded whatever the corpus: a term counts once per document, so terms in a share ``BAND[0]`` of the documents at least
are at most (mean number of distinct terms) / ``BAND[0]``; only these leave the counting job and are sent to the executors.

Defined results: terms are runs of ASCII letters, digits and other characters above U+007F, with A-Z lower-cased; a text without
a term of the lexicon is fingerprinted by all of its terms, one without terms by its bytes; a null text is empty; equal texts have equal
fingerprints, and equal fingerprints have likeness 1; rows without id follow the last id, in order of a hash of their texts; rows of one id follow
each other by their packed text; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import blocks, byte_column, mix, span_names, tidy

#: Document frequencies of the lexicon's terms, as shares of all documents.
BAND = (0.0005, 0.005)
RATES, EACH = tuple(0.25 * 0.4**k for k in range(8)), 16
SUBSETS = len(RATES) * EACH
#: Ids drawn for each stretch of ids, to cut the stretches at.
PER_STRETCH = 100
_FOLD = np.zeros(256, np.uint8)
for _b in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _FOLD[_b] = _b
_FOLD[65:91] = np.arange(97, 123)


def terms(data: np.ndarray, offsets: np.ndarray):
    """(text, term name) without repeats, sorted."""
    folded = _FOLD[data]
    inside = folded > 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    start[heads] = inside[heads]
    s = np.flatnonzero(start)
    stop = np.append(~inside, True)
    stop[offsets[1:]] = True
    stops = np.flatnonzero(stop)
    e = stops[np.searchsorted(stops, s, "right")] if len(s) else s
    name = span_names(folded, s, e)
    text = np.searchsorted(offsets, s, "right") - 1
    order = np.lexsort((name, text))
    text, name = text[order], name[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (name[1:] != name[:-1])
    return text[new], name[new]


def _frequencies(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        data, offsets = byte_column(batch.column("t"))
        found = []
        for r0, r1 in blocks(offsets, 1 << 20):
            _, name = terms(data[offsets[r0]: offsets[r1]], offsets[r0: r1 + 1] - offsets[r0])
            found.append(name)
        name, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(n, pa.int64())], names=["term", "n"])


def lexicon(texts: DataFrame, n_docs: int, band=BAND) -> np.ndarray:
    """Sorted names of the terms in the band, from counts over all of ``texts`` (t)."""
    counts = texts.select("t").mapInArrow(tidy(_frequencies), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = counts.where((F.col("n") >= band[0] * n_docs) & (F.col("n") <= max(2, band[1] * n_docs))).select("term").toArrow()
    return np.sort(found.column("term").to_numpy().astype(np.int64).view(np.uint64))


def memberships(names: np.ndarray) -> np.ndarray:
    """For each term the subsets that hold it, as two 64-bit masks."""
    out = np.zeros((len(names), SUBSETS // 64), np.uint64)
    for k in range(SUBSETS):
        limit = np.uint64(int(RATES[k // EACH] * 2**63) * 2)
        out[:, k // 64] |= (mix(names, np.uint64(k + 1)) < limit).astype(np.uint64) << np.uint64(k % 64)
    return out


class Fingerprints:
    def __init__(self, words: np.ndarray, members: np.ndarray):
        self.words, self.members = words, members

    def of(self, texts: list[bytes]) -> np.ndarray:
        """For each text and subset a hash of 12 bits, 0 where the text has no term in it."""
        sizes = np.array([len(t) for t in texts])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        text, name = terms(np.frombuffer(b"".join(texts), np.uint8), offsets)
        at = np.minimum(np.searchsorted(self.words, name), max(0, len(self.words) - 1))
        known = self.words[at] == name if len(self.words) else np.zeros(len(name), bool)
        has = np.bincount(text[known], minlength=len(texts)) > 0
        other = ~known & ~has[text]
        some = np.bincount(text, minlength=len(texts)) > 0
        rest = np.flatnonzero(~some)
        whole = np.array([int.from_bytes(hashlib.blake2b(texts[i], digest_size=8).digest(), "little") for i in rest], np.uint64)
        strange = np.concatenate([name[other], whole])
        text = np.concatenate([text[known], text[other], rest])
        name = np.concatenate([name[known], strange])
        masks = np.concatenate([self.members[at[known]], memberships(strange)]) if len(self.words) else memberships(strange)
        order = np.lexsort((name, text)) if len(strange) else slice(None)  # terms come sorted
        text, name, masks = text[order], name[order], masks[order]
        out = np.zeros((len(texts), SUBSETS), np.uint16)
        for k in range(SUBSETS):
            hit = np.flatnonzero(masks[:, k // 64] >> np.uint64(k % 64) & np.uint64(1))
            if not len(hit):
                continue
            owner = text[hit]
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            place = np.arange(len(hit)) - np.repeat(first, np.diff(np.append(first, len(hit))))
            total = np.add.reduceat(mix(name[hit], (place + 1).astype(np.uint64)), first)
            out[owner[first], k] = 1 + (mix(total, np.uint64(k)) >> np.uint64(30)).astype(np.int64) % 4095
        return out


def text_of(row: np.ndarray) -> str:
    return "".join(map("{:03x}".format, row.tolist()))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of rows of fingerprints."""
    either = ((a > 0) | (b > 0)).reshape(len(a), len(RATES), EACH)
    same = ((a == b) & (a > 0)).reshape(len(a), len(RATES), EACH)
    count = either.sum(axis=2)
    use = count <= EACH * 3 // 4
    use[:, -1] |= ~use.any(axis=1)
    n = np.where(use, count, 0).sum(axis=1)
    near = np.where(use, same.sum(axis=2), 0).sum(axis=1) / np.maximum(n, 1)
    return np.where((a == b).all(axis=1), 1.0, near)


def _bounds(texts: DataFrame, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The first value of each stretch of about equal numbers of values, with and without id. Each is a value of ``texts`` (no quantile: those go through doubles, which round ids beyond 2**53)."""
    kinds = {r["o"]: r for r in texts.groupBy("o").agg(F.count("*").alias("n"), F.min("v").alias("low")).collect()}
    total = sum(r["n"] for r in kinds.values())
    every = max(1, total // (n_parts * PER_STRETCH))
    some = texts.select("o", "v").where(F.pmod(F.xxhash64("v"), F.lit(every)) == 0).distinct().toArrow() if total else None
    out = []
    for o in (False, True):
        if o not in kinds:
            out.append(np.zeros(0, np.int64))
            continue
        drawn = np.sort(some.column("v").to_numpy()[some.column("o").to_numpy(zero_copy_only=False) == o])
        parts = max(1, round(n_parts * kinds[o]["n"] / total))
        out.append(np.unique(np.concatenate([[kinds[o]["low"]], drawn[len(drawn) * np.arange(1, parts) // parts] if len(drawn) else []]).astype(np.int64)))
    return out[0], out[1]


def _deal(bounds: tuple[np.ndarray, np.ndarray]):
    """Rows to their stretch; the first row of a stretch also to the one before it, to be looked at. Stretches without id come last."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        edges = np.concatenate(bounds)
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            o, v = batch.column("o").to_numpy(zero_copy_only=False), batch.column("v").to_numpy()
            part = np.where(o, len(bounds[0]) + np.searchsorted(bounds[1], v, "right"), np.searchsorted(bounds[0], v, "right")) - 1
            packed = [pack(t.as_py() or b"") for t in batch.column("t")]
            twice = np.flatnonzero(edges[part] == v)
            rows = pa.array(np.concatenate([np.arange(len(v)), twice]))
            parts = np.concatenate([part, (part[twice] - 1) % len(edges)])
            look = np.arange(len(parts)) >= len(v)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(look), *(batch.column(c).take(rows) for c in ("id", "v")), pa.array(packed, pa.binary()).take(rows)], names=["part", "look", "id", "v", "z"])
    return tidy(run)


def _stream(words):
    def run(batches: Iterator) -> Iterator:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        prints = Fingerprints(*words.value)
        rows: list[tuple[int | None, str, str]] = []  # id, text, text of the next
        size, before = 0, None
        for batch in batches:
            for part, look, i, z in zip(*(batch.column(c).to_pylist() for c in ("part", "look", "id", "z")), strict=True):
                text = unpack(z).decode("utf-8")
                if before and before[0] == part and not before[1]:
                    rows.append((before[2], before[3], text))
                    size += len(text)
                    if size > 1 << 19:
                        yield _block(prints, rows)
                        rows, size = [], 0
                before = part, look, i, text
        if rows:
            yield _block(prints, rows)
    return tidy(run)


def _block(prints: Fingerprints, rows: list[tuple[int | None, str, str]]):
    import pyarrow as pa

    own = [t.encode() for _, t, _ in rows]
    edited = [(t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode() for _, t, after in rows]
    following = [after.encode() for _, _, after in rows]
    extra = [i for i in range(len(rows)) if i + 1 == len(rows) or following[i] != own[i + 1]]
    codes = prints.of(own + edited + [following[i] for i in extra])
    n = len(rows)
    after = np.arange(1, n + 1)
    after[extra] = 2 * n + np.arange(len(extra))
    return pa.RecordBatch.from_arrays([
        pa.array([i for i, _, _ in rows], pa.int64()), pa.array([len(t) for _, t, _ in rows], pa.int64()),
        pa.array([hashlib.sha256(t).hexdigest() for t in edited]), pa.array(map(text_of, codes[:n]), pa.string()), pa.array(map(text_of, codes[n: 2 * n]), pa.string()),
        pa.array(likeness(codes[:n], codes[n: 2 * n])), pa.array(likeness(codes[:n], codes[after])),
    ], names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band=BAND) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each document in order of ids, those without id last."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    texts = texts.select("id", F.col("id").isNull().alias("o"), F.coalesce("id", F.xxhash64("t")).alias("v"), "t")
    n_parts = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(texts, n_parts)
    words = lexicon(texts, texts.count(), band)
    words = spark.sparkContext.broadcast((words, memberships(words)))  # bounded, see above
    dealt = texts.mapInArrow(_deal(bounds), "part int, look boolean, id long, v long, z binary")
    dealt = dealt.repartition(n_parts, "part").sortWithinPartitions("part", "look", "v", "z")
    return dealt.mapInArrow(_stream(words), "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op6(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return fingerprints(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
