"""LM scoring: an interpolated modified Kneser-Ney model of the whole training corpus, of trigrams by default.

Tokens and the runs of ``order`` tokens are counted in one shuffle of sorted, compressed blocks.
Each bucket of the hash range merges its blocks into a file of the shared folder and passes what
the order below counts: how many different tokens each shorter run follows.  Buckets follow the
hash's leading bits.  Runs of three tokens and more are dealt by their context, so a context's
totals need no further shuffle; a task holds all that follows a context, as distinct tokens.
Scoring maps the files into memory and looks up each piece's distinct runs.

Every run is stored, those seen once too.  A context followed by one token once isn't stored
itself: its run is known by the order below, and a known context without an entry is such a one.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cragspan.llm.session import new_path, saved
from cragspan.llm.words import Words, mix, pieces

#: Tokens whose bigrams and tokens whose words one bucket of the hash range should gather, and tokens counted before a flush.
BUCKET_TOKENS = 2_000_000
WORD_BUCKET_TOKENS = 16_000_000
LEAST_WORD_BITS = 4
#: Tokens of the longest run.
ORDER = 3
FLUSH_TOKENS = 4_000_000
BEGIN, END = np.uint64(0xB0B0B0B0B0B0B0B0), np.uint64(0xE0E0E0E0E0E0E0E1)
#: Rows from which on a block of bigrams or trigrams is written by words: a list of them costs less than the keys' bits.
WORDS_FROM = 16_384
_TOP = np.uint64(0xFFFFFFFF00000000)
_OPEN: dict[str, list[np.ndarray] | None] = {}


def _planes(x: np.ndarray) -> bytes:
    """All first bytes, then all second bytes and so on: high bytes are mostly zero, and compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def _listed(x: np.ndarray) -> tuple[bytes, np.ndarray]:
    """A list of the distinct words and each word's place in it: the more frequent first by doublings, ascending among the like, so that the list's steps are small."""
    words, at, number = np.unique(x, return_inverse=True, return_counts=True)
    by = np.lexsort((words, -np.frexp(number)[1]))
    rank = np.empty(len(by), np.uint32)
    rank[by] = np.arange(len(by), dtype=np.uint32)
    return len(words).to_bytes(8, "little") + _planes(np.diff(words[by], prepend=np.uint32(0))), rank[at]


def _pack(keys: np.ndarray, *columns: np.ndarray, pairs: bool = False) -> bytes:
    """A compressed block: each distinct key once, and how many rows it has.  Columns of 32 bits are words, given by their places in a list.

    Keys of bigrams (``pairs``) are given by both words in blocks of many rows, sorted by the words: those recur, while keys look random.
    """
    n = len(keys)
    if pairs and n >= WORDS_FROM:
        pair = _unmix(keys)
        words = [(pair >> np.uint64(32)).astype(np.uint32), pair.astype(np.uint32), *[x for x in columns if x.dtype == np.uint32]]
        listed, at = _listed(np.concatenate(words))
        ranks = [at[k * n : (k + 1) * n] for k in range(len(words))]
        order = np.lexsort(ranks[::-1])
        parts, same = [n.to_bytes(8, "little"), bytes(8), listed], np.zeros(n, bool)
        for k, rank in enumerate(ranks):  # steps from the row before, where the words in front are the same
            x = rank[order]
            step = np.diff(x, prepend=np.uint32(0))
            if k:
                step = np.where(same, step, x)
            parts.append(_planes(step))
            same = (same if k else np.arange(n) > 0) & (step == 0)
        parts += [_planes(x[order]) for x in columns if x.dtype != np.uint32]
    else:
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        parts = [n.to_bytes(8, "little"), len(first).to_bytes(8, "little"), _planes(np.diff(keys[first], prepend=np.uint64(0))), _planes(np.diff(first, append=n).astype(np.uint32))]
        for x in columns:
            parts += [*_listed(x)] if x.dtype == np.uint32 else [x]
        parts = [x if isinstance(x, bytes) else _planes(x) for x in parts]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(blob: bytes, kinds: list[type]) -> list[np.ndarray]:
    """The keys and columns of a block, in the order that it has them."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    begin = 0

    def planes(kind: type, n: int) -> np.ndarray:
        nonlocal begin
        size = np.dtype(kind).itemsize
        begin += size * n
        return np.ascontiguousarray(np.frombuffer(raw, np.uint8, size * n, begin - size * n).reshape(size, n).T).view(kind).ravel()

    def number() -> int:
        nonlocal begin
        begin += 8
        return int.from_bytes(raw[begin - 8 : begin], "little")

    def listed() -> np.ndarray:
        return np.cumsum(planes(np.uint32, number()), dtype=np.uint32)

    n, distinct = number(), number()
    if n and not distinct:
        words, found, same = listed(), [], np.zeros(n, bool)
        for k in range(2 + kinds.count(np.uint32)):
            step = planes(np.uint32, n)
            total = np.cumsum(step, dtype=np.uint32)
            if k:  # from where the words in front last changed
                start = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
                total = total - (total[start] - step[start])
            found.append(words[total])
            same = (same if k else np.arange(n) > 0) & (step == 0)
        rest = iter(found[2:])
        keys = mix((found[0].astype(np.uint64) << np.uint64(32)) | found[1])
        return [keys, *[next(rest) if kind == np.uint32 else planes(kind, n) for kind in kinds]]
    keys = np.cumsum(planes(np.uint64, distinct), dtype=np.uint64)
    out = [np.repeat(keys, planes(np.uint32, distinct))]
    for kind in kinds:
        out.append(listed()[planes(np.uint32, n)] if kind == np.uint32 else planes(kind, n))
    return out


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(order, first)``: the sort by the columns, the first foremost, and where in it each distinct row begins."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    return order, np.flatnonzero(new)


def _merge(parts: list[list[np.ndarray]], columns: int) -> list[np.ndarray]:
    """Sums of the columns by key, sorted."""
    if not parts:
        return [np.zeros(0, np.uint64)] + [np.zeros(0, np.int64)] * columns
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return [keys[first]] + [np.add.reduceat(np.concatenate([p[k + 1] for p in parts]).astype(np.int64)[order], first) if len(first) else np.zeros(0, np.int64) for k in range(columns)]


def _spread(kind: int, bits: int, keys: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Blocks ``(kind, bucket, block)`` of sorted keys."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(keys) else []
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        block = [c[a:z].astype(np.uint64) if c.dtype == np.int64 else c[a:z] for c in columns]
        yield kind, int(bucket[a]), _pack(keys[a:z], *block, pairs=kind in (RUNS + 2, RUNS + 3))


def _store(folder: str, name: str, bits: int, keys: np.ndarray, *columns: np.ndarray) -> None:
    """A file of sorted keys and their numbers in the shared folder; a second attempt of a task replaces it by the same.

    Beyond the bucket's bits a directory of places stands for the next bits of a key, about 16 keys
    each, and 32 bits follow.  Numbers take a byte; those over 254 are listed apart.
    """
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    own = f"{path}/.{name}-{uuid.uuid4().hex}"
    depth = min(max(len(keys) // 16, 1).bit_length(), 24)
    rest = keys << np.uint64(bits)
    places = np.searchsorted(rest >> np.uint64(64 - depth), np.arange(2**depth + 1, dtype=np.uint64)).astype(np.uint32)
    parts = [places, ((rest << np.uint64(depth)) >> np.uint64(32)).astype(np.uint32)]
    large = [np.flatnonzero(c > 254) for c in columns]
    parts += [x for c, i in zip(columns, large, strict=True) for x in (i.astype(np.uint32), c[i].astype(np.uint64))]
    parts += [np.minimum(c, 255).astype(np.uint8) for c in columns]
    with system.open_output_stream(own) as f:
        f.write(np.array([len(keys), depth, *map(len, large)], np.uint64).tobytes())
        for a in parts:
            f.write(np.ascontiguousarray(a).tobytes())
    system.move(own, f"{path}/{name}")


def _mapped(folder: str, name: str, columns: int) -> list[np.ndarray] | None:
    """The arrays of a file, mapped into memory; from a store without local paths by way of a file that is gone at once."""
    if (at := f"{folder}/{name}") in _OPEN:
        return _OPEN[at]
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(at)
    whole = None
    if isinstance(system, fs.LocalFileSystem):
        if os.path.exists(path):
            whole = np.memmap(path, np.uint8, "r")
    elif system.get_file_info(path).type != fs.FileType.NotFound:
        with tempfile.NamedTemporaryFile() as copy, system.open_input_stream(path) as f:
            while part := f.read(1 << 24):
                copy.write(part)
            copy.flush()
            whole = np.memmap(copy.name, np.uint8, "r")
    out = None
    if whole is not None:
        n, depth, *large = np.array(whole[: 8 * (2 + columns)]).view(np.uint64).astype(np.int64).tolist()
        begin, out = 8 * (2 + columns), []
        sizes = [(np.uint32, 2**depth + 1), (np.uint32, n), *[(kind, m) for m in large for kind in (np.uint32, np.uint64)], *[(np.uint8, n)] * columns]
        for kind, length in sizes:
            size = length * np.dtype(kind).itemsize
            out.append(whole[begin : begin + size].view(kind))
            begin += size
    _OPEN[at] = out
    return out


def _lookup(folder: str, prefix: str, bits: int, wanted: np.ndarray, columns: int) -> list[np.ndarray]:
    """The stored numbers of sorted distinct keys; 0 where there is none."""
    out = [np.zeros(len(wanted), np.int64) for _ in range(columns)]
    bucket = (wanted >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(wanted) else []
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        arrays = _mapped(folder, f"{prefix}-{bucket[a]}", columns)
        if arrays is None or not len(arrays[1]):
            continue
        places, stored = arrays[:2]
        depth = (len(places) - 1).bit_length() - 1
        rest = wanted[a:z] << np.uint64(bits)
        slot = (rest >> np.uint64(64 - depth)).astype(np.int64)
        key = ((rest << np.uint64(depth)) >> np.uint64(32)).astype(np.uint32)
        low, high = places[slot].astype(np.int64), places[slot + 1].astype(np.int64)
        end = high
        while (open_ := low < high).any():
            mid = (low + high) >> 1
            less = stored[np.minimum(mid, len(stored) - 1)] < key
            low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
        i = np.minimum(low, len(stored) - 1)
        hit = (low < end) & (stored[i] == key)
        for k, column in enumerate(out):
            at, value, small = arrays[2 + 2 * k], arrays[3 + 2 * k], arrays[2 + 2 * columns + k]
            found = np.where(hit, small[i], 0).astype(np.int64)
            if (over := np.flatnonzero(found == 255)).size:
                found[over] = value[np.searchsorted(at, i[over])]
            column[a:z] = found
    return out


def _tokens(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(token hashes, place in the text, text)``: each text's words and one end."""
    words = Words(raws, lower=True)
    total = len(words.hash) + len(raws)
    doc = np.repeat(np.arange(len(raws)), words.count + 1)
    last = np.cumsum(words.count + 1) - 1
    token = np.empty(total, np.uint64)
    token[last] = END
    inner = np.ones(total, bool)
    inner[last] = False
    token[inner] = words.hash
    return token, np.arange(total) - np.repeat(last - words.count, words.count + 1), doc


def _before(token: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The token ``k`` places before each; before a text's first there are begins."""
    out = np.full(len(token), BEGIN)
    inside = np.flatnonzero(place >= k)
    out[inside] = token[inside - k]
    return out


def _pair(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    """A bigram's key: both words' leading 32 bits, mixed (a bijection, undone by ``_unmix``)."""
    return mix((before & _TOP) | (token >> np.uint64(32)))


def _longer(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The key of a run of three tokens and more from that of the run without its last token."""
    return mix(context * _LONGER + (token >> np.uint64(32)))


def _contexts(token: np.ndarray, place: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the contexts of ``order - 1`` tokens, ``order - 2`` and so on to 2."""
    out = []
    for n in range(order - 1, 1, -1):
        key = _pair(_before(token, place, n), _before(token, place, n - 1))
        for k in range(n - 2, 0, -1):
            key = _longer(key, _before(token, place, k))
        out.append(key)
    return out


def _dealt(context: np.ndarray, run: np.ndarray, bits: int) -> np.ndarray:
    """Keys that lie in their context's bucket."""
    return (context >> np.uint64(64 - bits) << np.uint64(64 - bits)) | (run >> np.uint64(bits))


_LONGER = np.uint64(0xD1342543DE82EF95)
_UNDO = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))


def _unmix(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * _UNDO
    return x ^ (x >> np.uint64(32))


#: Kinds of blocks: 0 words, 1 ends and 2 starts of bigrams, 3 counts of counts, and runs of n tokens at RUNS + n.
RUNS = 100


def _counted(contexts: list[np.ndarray], last: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct runs, sorted by context and last token, and the sums of their numbers."""
    order, first = _distinct(contexts[0], last)
    total = np.add.reduceat(number.astype(np.int64)[order], first) if len(first) else np.zeros(0, np.int64)
    keep = order[first]
    return *[c[keep] for c in contexts], last[keep], total


def train(docs: DataFrame, text: str = "text", order: int = ORDER) -> dict:
    """Counts every text of ``docs`` (null: empty) and stores the model of runs of up to ``order`` tokens, 2 at least; returns its place and totals.

    Nothing of the corpus but these totals reaches the driver.
    """
    if order < 2:
        raise ValueError("order must be 2 at least")
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text") + 1).alias("bytes"), F.count("*").alias("texts")).first()
    texts = size["texts"]
    tokens = (size["bytes"] or 0) // 6
    bits = max(1, int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // BUCKET_TOKENS) - 1).bit_length())
    word_bits = max(LEAST_WORD_BITS, int(tokens // WORD_BUCKET_TOKENS).bit_length())
    folder = new_path(spark, "language-model")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pd.DataFrame:
            token, *runs = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            rows = list(_spread(0, word_bits, *np.unique(token, return_counts=True)))
            if order == 2:
                rows += _spread(RUNS + 2, bits, *np.unique(runs[0], return_counts=True))
            else:
                rows += _spread(RUNS + order, bits, *_counted(runs, (token >> np.uint64(32)).astype(np.uint32), np.ones(len(token), np.int64)))
            return pd.DataFrame(rows, columns=["kind", "bucket", "block"])

        for b in batches:
            for _, _, raws in pieces(b["text"].tolist()):
                token, place, _ = _tokens(raws)
                held.append((token, *_contexts(token, place, order)) if order > 2 else (token, _pair(_before(token, place, 1), token)))
                if sum(len(x[0]) for x in held) >= FLUSH_TOKENS:
                    yield flush()
        if held:
            yield flush()

    def tally(n: int, number: np.ndarray) -> tuple[int, int, bytes]:
        return 3, -n, np.bincount(np.minimum(number, 5), minlength=6).astype(np.int64).tobytes()

    def classes(number: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
        """By context the sum of the numbers, and how many are 1, 2, and 3 or more."""
        return [np.bincount(at, w, size).astype(np.int64) for w in (number, number == 1, number == 2, number > 2)]

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, bucket = int(pdf["kind"].iloc[0]), int(pdf["bucket"].iloc[0])
        n = kind - RUNS
        if not kind:
            rows = list(_spread(0, word_bits, *_merge([_unpack(x, [np.uint64]) for x in pdf["block"]], 1)))
        elif n < 2:
            return pdf[["kind", "bucket", "block"]]
        elif n > 2:
            parts = [_unpack(x, [np.uint64] * (n - 3) + [np.uint32, np.uint64]) for x in pdf["block"]]
            *contexts, last, number = _counted([np.concatenate(x) for x in zip(*[p[:-2] for p in parts], strict=True)], *[np.concatenate([p[k] for p in parts]) for k in (-2, -1)])
            del parts
            keys = _dealt(contexts[0], _longer(contexts[0], last.astype(np.uint64) << np.uint64(32)), bits)
            by = np.argsort(keys)
            _store(folder, f"runs{n}-{bucket}", bits, keys[by], number[by])
            new = np.ones(len(last), bool)
            new[1:] = contexts[0][1:] != contexts[0][:-1]
            total = classes(number, np.cumsum(new) - 1, int(new.sum()))
            lone = (total[0] == 1) & (_unmix(contexts[-1][new]) << np.uint64(32) != BEGIN & _TOP)
            _store(folder, f"contexts{n - 1}-{bucket}", bits, contexts[0][new][~lone], *[x[~lone] for x in total])
            rows = [tally(n, number)]
            if n == 3:
                rows += _spread(RUNS + 2, bits, *np.unique(mix((_unmix(contexts[0]) << np.uint64(32)) | last), return_counts=True))
            else:
                rows += _spread(RUNS + n - 1, bits, *_counted(contexts[1:], last, np.ones(len(last), np.int64)))
        else:
            keys, number = _merge([_unpack(x, [np.uint64]) for x in pdf["block"]], 1)
            _store(folder, f"runs2-{bucket}", bits, keys, number)
            pair = _unmix(keys)
            rows = [tally(2, number), *_spread(1, word_bits, *np.unique(pair << np.uint64(32), return_counts=True))]
            starts, at = np.unique(pair & _TOP, return_inverse=True)
            rows += _spread(2, word_bits, starts, *classes(number, at, len(starts)))
        return pd.DataFrame(rows, columns=["kind", "bucket", "block"])

    def words(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        one = pdf["kind"].to_numpy()
        keys, number = _merge([_unpack(x, [np.uint64]) for x in pdf["block"][one == 0]], 1)
        ends, types = _merge([_unpack(x, [np.uint64]) for x in pdf["block"][one == 1]], 1)
        starts, *total = _merge([_unpack(x, [np.uint64] * 4) for x in pdf["block"][one == 2]], 4)
        own = keys & _TOP

        def of(known: np.ndarray, column: np.ndarray) -> np.ndarray:
            if not len(known):
                return np.zeros(len(own), np.int64)
            i = np.minimum(np.searchsorted(known, own), len(known) - 1)
            return np.where(known[i] == own, column[i], 0)

        after = of(ends, types)
        _store(folder, f"words-{bucket}", word_bits, keys, number, after, *[of(starts, k) for k in total])
        begin = np.searchsorted(starts, BEGIN & _TOP)
        found = [k[begin] if begin < len(starts) and starts[begin] == BEGIN & _TOP else 0 for k in total]
        tally = np.bincount(np.minimum(after, 5), minlength=6)
        return pd.DataFrame({"tokens": [int(number.sum())], "distinct": [len(keys)], "types": [int(after.sum())], **{f"t{k}": [int(tally[k])] for k in range(1, 5)}, "t3up": [int((after > 2).sum())], **{f"b{k}": [int(x)] for k, x in enumerate(found)}})

    blocks = "kind int, bucket long, block binary"
    counted = docs.mapInPandas(count, blocks)
    for _ in range(order - 1):
        counted = counted.groupBy("kind", "bucket").applyInPandas(merge, blocks)
    counted = saved(counted, "lm-counted")
    # few rows for each bucket of runs: counts of counts, added up by order
    rows = counted.where("kind = 3").select("bucket", "block")
    sums = rows.mapInPandas(_tallies, "bucket long, c1 long, c2 long, c3 long, c4 long").groupBy("bucket").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(1, 5)]).collect()
    sums = {-r["bucket"]: [r[f"c{k}"] for k in range(1, 5)] for r in sums}
    names = ["tokens", "distinct", "types", "t1", "t2", "t3", "t4", "t3up", "b0", "b1", "b2", "b3"]
    table = counted.where("kind < 3").groupBy("bucket").applyInPandas(words, ", ".join(f"{c} long" for c in names))
    total = table.agg(*[F.sum(c).alias(c) for c in names]).first().asDict()
    model = {k: int(v or 0) for k, v in total.items()} | {"folder": folder, "bits": bits, "word_bits": word_bits, "texts": texts, "order": order}
    return model | {"discounts": {n: _discounts(sums.get(n, [0] * 4)) for n in range(2, order + 1)}, "word_discounts": _discounts([model[f"t{k}"] for k in range(1, 5)])}


def _tallies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        counts = [np.frombuffer(x, np.int64) for x in b["block"]]
        yield pd.DataFrame({"bucket": b["bucket"], **{f"c{k}": [x[k] for x in counts] for k in range(1, 5)}})


def _discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts by count (0, 1, 2, 3 and more) from the numbers of n-grams counted once to four times."""
    n = [max(1, x) for x in n]
    y = n[0] / (n[0] + 2 * n[1])
    return [0.0, *[min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]]


def log_probabilities(model: dict, raws: list[bytes]) -> tuple[np.ndarray, ...]:
    """``(text, log10 p, log10 of the add-one base, whether known)`` of each token."""
    token, place, doc = _tokens(raws)
    folder, bits = model["folder"], model["bits"]
    before = _before(token, place, 1)
    each, at = np.unique(np.concatenate([token, before]), return_inverse=True)
    count, after, *words = _lookup(folder, "words", model["word_bits"], each, 6)
    begin = np.searchsorted(each, BEGIN)
    if begin < len(each) and each[begin] == BEGIN:
        for k, x in enumerate(words):
            x[begin] = model[f"b{k}"]
    u = np.array(model["word_discounts"])
    types, size = max(1, model["types"]), model["distinct"] + 1
    saved_ = (u[1] * model["t1"] + u[2] * model["t2"] + u[3] * model["t3up"]) / types if model["types"] else 1.0
    low = (after - u[np.minimum(after, 3)]) / types + saved_ / size
    own, ctx = at[: len(token)], at[len(token) :]

    def found(prefix: str, keys: np.ndarray, columns: int) -> list[np.ndarray]:
        distinct, back = np.unique(keys, return_inverse=True)
        return [x[back] for x in _lookup(folder, prefix, bits, distinct, columns)]

    p, total = low[own], [x[ctx] for x in words]
    contexts = [_pair(before, token), *_contexts(token, place, model["order"])[::-1]]
    for n in range(2, model["order"] + 1):
        if n == 2:
            (seen,) = found("runs2", contexts[0], 1)
        else:
            context = contexts[n - 2]
            total = found(f"contexts{n - 1}", context, 4)
            lone = (total[0] == 0) & (place > 0) & (np.concatenate([[0], seen[:-1]]) > 0)  # known, and followed by one token once
            total[0][lone] = total[1][lone] = 1
            (seen,) = found(f"runs{n}", _dealt(context, _longer(context, token), bits), 1)
        d = np.array(model["discounts"][n])
        seen = np.where(total[0] > 0, seen, 0)
        of = np.maximum(total[0], 1)
        left = np.where(total[0] > 0, (d[1] * total[1] + d[2] * total[2] + d[3] * total[3]) / of, 1.0)
        p = np.minimum((seen - d[np.minimum(seen, 3)]) / of, 1.0) + np.minimum(left, 1.0) * p
    known = count[own] > 0
    base = (count[own] + 1.0) / (model["tokens"] + size)
    return doc, np.log10(np.minimum(p, 1.0)), np.log10(base), known


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, n_known, base_score and score (log10 probability) of every whole text.

    Tokens are a text's words, A-Z lower-cased, and one end; a null text is empty and has its end.
    The perplexity of a text is ``10 ** (-score / n_tokens)``.  Columns of these four names are replaced.
    """

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = []
            for _, _, raws in pieces(texts.tolist()):
                doc, p, base, known = log_probabilities(model, raws)
                n = len(raws)
                found.append(pd.DataFrame({"n_tokens": np.bincount(doc, minlength=n), "n_known": np.bincount(doc[known], minlength=n), "base_score": np.bincount(doc, base, n), "score": np.bincount(doc, p, n)}))
            yield pd.concat(found, ignore_index=True) if found else pd.DataFrame({"n_tokens": [], "n_known": [], "base_score": [], "score": []})

    judged = F.pandas_udf(judge, "n_tokens long, n_known long, base_score double, score double")
    names = ("n_tokens", "n_known", "base_score", "score")
    own = [c for c in docs.columns if c not in names]
    return docs.select(*own, judged(F.col(text)).alias("_lm")).select(*own, *[f"_lm.{c}" for c in names])
