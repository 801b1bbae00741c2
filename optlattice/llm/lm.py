"""Language-model scores by context-tree weighting over bytes (operator 7)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import coded, hashed, run_sums, save, starts, words_of

#: Bytes of the longest context.
DEPTH = 5
#: Bytes of text, and documents, of a group, whose distinct words and contexts are looked up together.
GROUP_BYTES, GROUP_DOCS = 12_000_000, 50_000
#: Groups in one list of those that have a word or context; beyond it there are several lists.
LISTED = 4_096
#: Grams of a subtree that one task works on; a larger one is split by the next byte of its contexts.
GROUP_GRAMS = 100_000
#: Split subtrees that are broadcast; more are joined.
BROADCAST_ROWS = 500_000
WORD, GRAM = 0, 1
#: Characters of a group that are worked on at a time, and distinct keys that wait to be summed up.
PART_CHARS, WAITING = 600_000, 400_000
_HALF = np.log(0.5)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 0.5, to about 1e-12 of its size."""
    x = np.asarray(x, dtype=float)
    low = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        low[small] += np.log(y[small])
        y[small] += 1
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - low


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of any sequence with n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1) - np.log(np.pi)


def share(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Posterior weight of a node's own estimate against its children's, from the ln probabilities of both (1/2 each before)."""
    return 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


class Level:
    """The nodes of one depth: contexts of that many bytes with the bits read of the next byte, and their counts."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.key, self.first, self.back = np.unique(key, return_index=True, return_inverse=True)
        self.n0 = np.bincount(self.back, weights=zeros, minlength=len(self.key))
        self.n1 = np.bincount(self.back, weights=ones, minlength=len(self.key))
        self.own = log_kt(self.n0, self.n1)
        self.below = self.own
        self.total = self.own

    def over(self, child: Level) -> Level:
        """Weighs this level's estimates with those of the next longer contexts."""
        self.below = np.bincount(self.back[child.first], weights=child.total, minlength=len(self.key))
        self.total = np.logaddexp(self.own + _HALF, self.below + _HALF)
        return self


def _bits(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte its 8 bits, and the number (1 to 255) of the bits before each."""
    k = np.arange(8)
    return (byte[:, None] >> (7 - k)) & 1, (1 << k) | (byte[:, None] >> (8 - k))


def tree(gram: np.ndarray, n: np.ndarray, top: int, depth: int = DEPTH) -> tuple[list[Level], np.ndarray, np.ndarray]:
    """The levels from depth `top` to `depth` over grams (contexts with their next byte) that share their last `top` context bytes."""
    context, byte = gram >> 8, gram & 255
    bit, prefix = _bits(byte)
    bit, prefix = bit.reshape(-1), prefix.reshape(-1)
    zeros, ones = np.repeat(n, 8) * (bit == 0), np.repeat(n, 8) * (bit == 1)
    levels = []
    for d in range(top, depth + 1):
        key = np.repeat(context & ((1 << 8 * d) - 1), 8) << 8 | prefix
        levels.append(Level(key, zeros, ones))
    for d in range(len(levels) - 2, -1, -1):
        levels[d].over(levels[d + 1])
    return levels, bit, prefix


def mixed(levels: list[Level], bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The probability of each bit from the first level's node down, and whether that node was ever seen.

    A longer context that wasn't seen in training has no say: its parent's own estimate stands.
    """
    p, seen = None, None
    for level in reversed(levels):
        n0, n1 = level.n0[level.back], level.n1[level.back]
        own = (np.where(bit == 1, n1, n0) + 0.5) / (n0 + n1 + 1)
        if p is None:
            p = own
        else:
            s = share(level.own, level.below)[level.back]
            p = np.where(seen, s * own + (1 - s) * p, own)
        seen = n0 + n1 > 0
    return p, seen


def _grams(lines: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every byte of every line, one line after the other, and the bytes of each line. Zeros stand before a line."""
    pad = b"\0" * depth
    flat = np.frombuffer(b"".join(pad + x for x in lines), dtype=np.uint8).astype(np.int64)
    size = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    code = np.zeros(max(0, len(flat) - depth), dtype=np.int64)
    for k in range(depth + 1):
        code = code << 8 | flat[k : k + len(code)]
    begin = starts(size + depth)[:-1]
    at = np.repeat(begin - starts(size)[:-1], size) + np.arange(int(size.sum()))
    return code[at], size


def _parts(texts: list[str]):
    """Slices of a group's texts with a bounded number of characters."""
    begin = 0
    while begin < len(texts):
        total, end = 0, begin
        while end < len(texts) and (end == begin or total + len(texts[end]) <= PART_CHARS):
            total += len(texts[end])
            end += 1
        yield slice(begin, end)
        begin = end


def line_of(words: list[bytes]) -> bytes:
    """The bytes that the model reads: words with single spaces between them, then a line end."""
    return b" ".join(words) + b"\n"


def _word_keys(distinct: np.ndarray) -> np.ndarray:
    return hashed(distinct).view(np.int64)


#: Stands for the end of a text among the word keys.
END = int(_word_keys(np.array([b"\n"], dtype=object))[0])


class Counts:
    """Counts of keys, summed up whenever many are waiting."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
        self.keys.append(keys[first])
        self.counts.append(np.add.reduceat(counts[order].astype(np.int64), first) if len(first) else np.zeros(0, dtype=np.int64))
        self.waiting += len(first)
        if self.waiting > WAITING and len(self.keys) > 1:
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) != 1:
            keys, counts = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (self.keys, self.counts))
            self.keys, self.counts, self.waiting = [], [], -len(keys)
            self.add(keys, counts)
            self.waiting = 0
        return self.keys[0], self.counts[0]


def gather(rows: pd.DataFrame, depth: int = DEPTH) -> pd.DataFrame:
    """The distinct word keys and grams of a group's documents, with their counts in its training documents."""
    texts, training = [t or "" for t in rows["_text"]], rows["_train"].to_numpy(dtype=bool)
    words, grams = Counts(), Counts()
    for part in _parts(texts):
        lists = [words_of(t) for t in texts[part]]
        codes, distinct, counts = coded(lists)
        learn = np.repeat(training[part], counts)
        words.add(np.r_[_word_keys(distinct), END], np.r_[np.bincount(codes[learn], minlength=len(distinct)), training[part].sum()])
        gram, size = _grams([line_of(x) for x in lists], depth)
        grams.add(gram, np.repeat(training[part], size))
    out = []
    for kind, counts in ((WORD, words), (GRAM, grams)):
        key, n = counts.total()
        out.append(pd.DataFrame({"kind": np.int32(kind), "key": key, "n": n}))
    return pd.concat(out, ignore_index=True)


class Lookup:
    """Values of grams in a table with at least two slots for each; a taken slot leads to the next one."""

    def __init__(self, gram: np.ndarray, value: np.ndarray):
        self.bits = max(4, int(len(gram)).bit_length() + 1)
        self.gram = np.full(1 << self.bits, -1, dtype=np.int64)
        self.value = np.zeros(1 << self.bits)
        left, at = np.arange(len(gram)), self._slot(gram)
        while len(left):
            free = self.gram[at] < 0
            self.gram[at[free]] = gram[left[free]]  # of several the last one stays
            here = self.gram[at] == gram[left]
            self.value[at[here]] = value[left[here]]
            left, at = left[~here], (at[~here] + 1) & ((1 << self.bits) - 1)

    def _slot(self, gram: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, gram: np.ndarray) -> np.ndarray:
        """The value of each gram; every gram must be there."""
        at = self._slot(gram)
        miss = np.flatnonzero(self.gram[at] != gram)
        while len(miss):
            at[miss] = (at[miss] + 1) & ((1 << self.bits) - 1)
            miss = miss[self.gram[at[miss]] != gram[miss]]
        return self.value[at]


def score_group(rows: pd.DataFrame, known: pd.DataFrame, total: int, distinct_words: int, depth: int = DEPTH) -> pd.DataFrame:
    """Scores a group's documents with the values of its words (training counts) and grams (log10 probabilities)."""
    kind, key, value = known["kind"].to_numpy(), known["key"].to_numpy(), known["value"].to_numpy()
    word_key, word_count = key[kind == WORD], value[kind == WORD]
    order = np.argsort(word_key)
    word_key, word_count = word_key[order], word_count[order]
    find = Lookup(key[kind == GRAM], value[kind == GRAM])
    texts = [t or "" for t in rows["_text"]]
    scale = np.log10(float(total + distinct_words + 1))
    out = []
    for part in _parts(texts):
        lists = [words_of(t) for t in texts[part]]
        codes, distinct, counts = coded(lists)
        count = word_count[np.searchsorted(word_key, _word_keys(distinct))] if len(distinct) else np.zeros(0)
        ends = word_count[np.searchsorted(word_key, END)]
        base = run_sums(np.log10(count + 1)[codes], counts) + np.log10(ends + 1) - (counts + 1) * scale
        seen = run_sums((count > 0).astype(np.int64)[codes], counts) + int(ends > 0)
        gram, size = _grams([line_of(x) for x in lists], depth)
        out.append(pd.DataFrame({"n_tokens": counts + 1, "n_known": seen, "base_score": base, "score": run_sums(find.get(gram), size), "n_bytes": size}))
    result = pd.concat(out, ignore_index=True)
    result.insert(0, "train_tokens", total)
    result.insert(0, "_row", rows["_row"].to_numpy())
    return result


def _ending(n: int) -> Column:
    """The last n bytes of a gram's context."""
    return F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * n) - 1))


def _subtrees(grams: DataFrame) -> DataFrame:
    """(key, n, s, root): each gram with the subtree that a task works on, that of the last s bytes of its context.

    s is 2, or 3 where more than GROUP_GRAMS grams share two bytes, or 4 where more share three; four bytes leave room for
    65,536 grams. At most 65,536 pairs of bytes are broadcast; split triples only if they are few.
    """
    three = grams.groupBy(_ending(3).alias("e3")).agg(F.count("*").alias("c"))
    two = three.groupBy(F.col("e3").bitwiseAND(F.lit(0xFFFF)).alias("e2")).agg(F.sum("c").alias("c"))
    wide2 = save(two.where(F.col("c") > GROUP_GRAMS).select("e2", F.lit(True).alias("w2")), "lm-pairs")
    wide3 = save(three.where(F.col("c") > GROUP_GRAMS).select("e3", F.lit(True).alias("w3")), "lm-triples")
    few = wide3.count() <= BROADCAST_ROWS
    rows = grams.select("key", "n", _ending(2).alias("e2"), _ending(3).alias("e3")).join(F.broadcast(wide2), "e2", "left").join(F.broadcast(wide3) if few else wide3, "e3", "left")
    s = F.when(F.col("w3"), 4).when(F.col("w2"), 3).otherwise(2)
    root = F.when(F.col("w3"), _ending(4)).when(F.col("w2"), F.col("e3")).otherwise(F.col("e2"))
    return rows.select("key", "n", s.alias("s"), root.alias("root"))


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("total", "share")]))
def _weighed(n0: pd.Series, n1: pd.Series, below: pd.Series) -> pd.DataFrame:
    """A node's weighted ln probability and the weight of its own estimate, from its counts and its children's sum."""
    own, below = log_kt(n0.to_numpy(dtype=float), n1.to_numpy(dtype=float)), below.to_numpy(dtype=float)
    return pd.DataFrame({"total": np.logaddexp(own + _HALF, below + _HALF), "share": share(own, below)})


def _lifted(nodes: DataFrame, d: int) -> DataFrame:
    """The nodes (node, n0, n1, total, share) of depth d from all their children."""
    parent = F.shiftleft(F.shiftright("node", 8).bitwiseAND(F.lit((1 << 8 * d) - 1)), 8).bitwiseOR(F.col("node").bitwiseAND(F.lit(255)))
    sums = nodes.groupBy(parent.alias("node")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("total").alias("below"))
    return sums.withColumn("_w", _weighed("n0", "n1", "below")).select("node", "n0", "n1", "_w.total", "_w.share")


def gram_values(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, value): the log10 probability of each gram's last byte after its context, from the grams' training counts n.

    Groups of grams that share the ends of their contexts are subtrees of the context tree; see _subtrees(). Their roots'
    sums make the nodes above them, level by level, up to depth 2; split subtrees get these nodes by a join. The two
    levels above, 65,792 nodes at most, go to the driver and to every task.
    """
    rows = _subtrees(grams)

    def roots(key, group):
        levels, _, _ = tree(group["key"].to_numpy(), group["n"].to_numpy(), int(key[0]), depth)
        low = levels[0]
        return pd.DataFrame({"s": np.int32(key[0]), "node": low.key, "n0": low.n0, "n1": low.n1, "total": low.total})

    sums = save(rows.groupBy("s", "root").applyInPandas(roots, "s int, node long, n0 double, n1 double, total double"), "lm-roots")
    columns = ("node", "n0", "n1", "total")
    three = _lifted(sums.where("s = 4"), 3)
    two = _lifted(sums.where("s = 3").select(*columns).unionByName(three.select(*columns)), 2)
    one = sums.where("s = 2").select(*columns).unionByName(two.select(*columns))
    parent = F.col("node").bitwiseAND(F.lit(0xFFFF)).alias("node")
    top = one.groupBy(parent).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("total").alias("below")).toPandas().sort_values("node")
    tables = _top_tables(top)
    split = rows.where("s > 2").select(F.col("s").alias("under"), F.col("root").alias("end")).distinct()
    at = lambda nodes, d: nodes.select(F.lit(d).alias("d"), F.shiftright("node", 8).alias("e"), "node", "n0", "n1", "share")
    above = split.withColumn("e", F.col("end").bitwiseAND(F.lit(0xFFFF))).join(at(two, 2), "e").unionByName(split.where("under = 4").withColumn("e", F.col("end").bitwiseAND(F.lit(0xFFFFFF))).join(at(three, 3), "e"))

    def values(key, group, upper):
        gram = group["key"].to_numpy()
        levels, bit, prefix = tree(gram, group["n"].to_numpy(), int(key[0]), depth)
        p, seen = mixed(levels, bit)
        over = []
        for d in range(int(key[0]) - 1, 1, -1):
            known = upper[upper["d"] == d].sort_values("node")
            place = np.searchsorted(known["node"].to_numpy(), np.repeat(gram >> 8 & ((1 << 8 * d) - 1), 8) << 8 | prefix)
            over.append((known["share"].to_numpy(), known["n0"].to_numpy(), known["n1"].to_numpy(), place))
        over += [(*tables[1], np.repeat(gram >> 8 & 255, 8) << 8 | prefix), (*tables[0], prefix)]
        for share_of, n0, n1, place in over:
            a, b = n0[place], n1[place]
            own = (np.where(bit == 1, b, a) + 0.5) / (a + b + 1)
            s = share_of[place]
            p, seen = np.where(seen, s * own + (1 - s) * p, own), a + b > 0
        return pd.DataFrame({"key": gram, "value": np.log10(p).reshape(-1, 8).sum(axis=1)})

    return rows.groupBy("s", "root").cogroup(above.groupBy("under", "end")).applyInPandas(values, "key long, value double")


def _top_tables(top: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(share, n0, n1) of all nodes at depth 0 (by bits read) and 1 (by byte and bits read)."""
    node = top["node"].to_numpy()
    n0, n1, below = (np.bincount(node, weights=top[c].to_numpy(), minlength=1 << 16) for c in ("n0", "n1", "below"))
    own = log_kt(n0, n1)
    one = (share(own, below), n0, n1)
    total = np.logaddexp(own + _HALF, below + _HALF)
    total[n0 + n1 == 0] = 0
    n0, n1, below = (x.reshape(256, 256).sum(axis=0) for x in (n0, n1, total))
    return [(share(log_kt(n0, n1), below), n0, n1), one]


def scores(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), depth: int = DEPTH) -> DataFrame:
    """(id, `keep`, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of all whole texts.

    Learns from the rows that fulfil `training`. A text is read as its words (A-Z in lower case) with single spaces
    and a line end; a null text counts as empty. score is the model's log10 probability of these bytes, base_score that of the words under
    their training counts plus one. Words are told apart by 64-bit hashes. Without training rows every bit has
    probability 1/2. Repeated rows give repeated rows; an empty table none.

    Documents are dealt to groups of about as many bytes; a group's distinct words and contexts are joined with their
    corpus values and come back to the group, so no table of the corpus is broadcast. The groups that have a word or
    context are listed, at most LISTED in a list.
    """
    rows = docs.select(F.struct(id_col, *keep).alias("_row"), F.col(text_col).alias("_text"), F.coalesce(training, F.lit(False)).alias("_train"))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)).alias("bytes")).first()
    groups = max(1, -(-size["n"] // GROUP_DOCS), -(-size["bytes"] // GROUP_BYTES))
    rows = rows.withColumn("g", F.pmod(F.xxhash64("_row", F.length("_text"), F.xxhash64("_text")), F.lit(groups)).cast("int"))

    def gathered(key, group):
        return gather(group, depth).assign(g=np.int32(key[0]))

    found = rows.select("g", "_text", "_train").groupBy("g").applyInPandas(gathered, "kind int, key long, n long, g int")
    one_list = groups <= LISTED
    part = [] if one_list else [F.floor(F.col("g") / LISTED).alias("part")]
    listed = save(found.groupBy("kind", "key", *part).agg(F.sum("n").alias("n"), F.collect_list("g").alias("gs")), "lm-corpus")
    corpus = listed if one_list else save(listed.groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")
    words = corpus.where(F.col("kind") == WORD)
    size = words.agg(F.sum("n").alias("total"), F.sum((F.col("n") > 0).cast("long")).alias("distinct")).first()
    total, distinct = int(size["total"] or 0), int(size["distinct"] or 0)
    grams = gram_values(corpus.where(F.col("kind") == GRAM).select("key", "n"), depth)
    words = words if one_list else listed.where(F.col("kind") == WORD).select("key", "gs").join(words.select("key", "n"), "key")
    listed_grams = listed.where(F.col("kind") == GRAM).select("key", "gs").join(grams, "key")
    known = lambda rows, kind, value: rows.select(F.lit(kind).alias("kind"), "key", value.cast("double").alias("value"), F.explode("gs").alias("g"))
    every = known(words, WORD, F.col("n")).unionByName(known(listed_grams, GRAM, F.col("value")))

    def scored(group, known):
        return score_group(group, known, total, distinct, depth)

    kind = rows.schema["_row"].dataType.simpleString()
    numbers = "n_tokens long, n_known long, base_score double, score double, n_bytes long"
    out = rows.select("g", "_row", "_text").groupBy("g").cogroup(every.groupBy("g")).applyInPandas(scored, f"_row {kind}, train_tokens long, {numbers}")
    bits = -F.col("score") * F.lit(np.log2(10.0)) / F.col("n_bytes")
    return out.select("_row.*", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", bits.alias("bits_per_byte"))
