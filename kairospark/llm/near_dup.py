"""Near-duplicate detection: BagMinHash signatures of word shingles, bands, and exact multiset overlap."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairospark.llm.columns import lists, slices, stored, tidied, utf8
from kairospark.llm.components import components
from kairospark.llm.hashing import mix, windows, word_hashes, word_spans
from kairospark.llm.skew import joined, with_facts

_STEP, _RING, _PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and where each row's words begin; hashes of the rows' shingles, `size` neighbouring words, and their rows. A row of fewer words has one shingle, of all of them, or none without words."""
    data, offsets = utf8(column)
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    n = np.diff(first)
    at = np.flatnonzero(np.arange(len(words)) + size <= np.repeat(first[1:], n))
    rows = np.repeat(np.arange(len(n)), np.maximum(0, n - size + 1))
    few = np.flatnonzero((n > 0) & (n < size))
    short = [windows(words[first[k] : first[k + 1]], int(n[k]), 100 + int(n[k]))[0] for k in few]
    return words, first, np.concatenate([windows(words, size)[at] if len(at) else np.zeros(0, np.uint64), np.array(short, np.uint64)]), np.concatenate([rows, few])


def counted(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, row) and how often each occurs."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.ones(len(h) + 1, bool)
    new[1:-1] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    return h[at[:-1]], r[at[:-1]], np.diff(at)


def bag_minhash(hashes: np.ndarray, rows: np.ndarray, counts: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n, m) of weighted sets: two agree in a component with the probability of their weighted Jaccard similarity.

    Weights are whole numbers, cut into rings (0, 1], (1, 2], (2, 4], (4, 8] and so on. Each element has a Poisson process in every ring that its weight reaches, with the ring's width as rate: points in time, each with a component and a place in the ring. Points placed above the weight are passed over, so a heavier element has all points of a lighter one and more. A component keeps the time of its first point. All processes go on in step, and each stops once its time is later than the first points of all components of its row, after about n + m log m points instead of n times m.
    """
    rings = np.where(counts > 1, np.ceil(np.log2(np.maximum(counts, 1))), 0).astype(np.int64) + 1
    which = np.repeat(np.arange(len(hashes)), rings)
    ring = np.arange(len(which)) - np.repeat(np.cumsum(rings) - rings, rings)
    seed = mix(hashes[which] + ring.astype(np.uint64) * _RING)
    low = np.where(ring > 0, 1 << np.maximum(ring - 1, 0), 0)
    rate = np.maximum(low, 1).astype(np.float64)
    row, most = rows[which], counts[which]
    first = np.full(n * m, np.inf)
    time, alive, limit, step = np.zeros(len(which)), np.arange(len(which)), np.full(n, np.inf), 0
    while len(alive):
        step += 1
        u = mix(seed[alive] + np.uint64(step * int(_STEP) % 2**64))
        time[alive] -= np.log(((u >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / rate[alive]
        alive, u = (x[time[alive] < limit[row[alive]]] for x in (alive, u))
        v = mix(u ^ _PLACE)
        component = ((v >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        level = low[alive] + ((v & np.uint64(0xFFFFFFFF)) * rate[alive].astype(np.uint64) >> np.uint64(32)).astype(np.int64) + 1
        inside = level <= most[alive]
        np.minimum.at(first, row[alive[inside]] * m + component[inside].astype(np.int64), time[alive[inside]])
        own = np.unique(row[alive]) if len(alive) < n else slice(None)
        limit[own] = first.reshape(n, m)[own].max(1)
        alive = alive[time[alive] < limit[row[alive]]]
    return first.reshape(n, m)


def banded(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of a signature."""
    bits = mix(signatures.view(np.uint64)).reshape(len(signatures), bands, -1)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _RING, bits.shape[:2]).copy()
    for k in range(bits.shape[2]):
        key = mix(key * _STEP + bits[:, :, k])
    return key.view(np.int64)


def prints(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, per_band: int) -> DataFrame:
    """(id, print, bands) of each row: a 128-bit fingerprint of its words in order, and its band keys, none for a text of fewer words than a shingle, which can only equal another."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            words, first, hashes, rows = shingles(batch.column("text"), size)
            n = np.diff(first)
            long = n >= size
            number = np.cumsum(long) - 1
            keep = long[rows]
            keys = banded(bag_minhash(*counted(hashes[keep], number[rows[keep]]), int(long.sum()), bands * per_band), bands)
            own = [hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.record_batch([batch.column("id"), pa.array(own, pa.binary()), lists(keys.ravel(), np.concatenate([[0], np.cumsum(long) * bands]))], ["id", "print", "bands"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, print binary, bands array<long>")


def printed_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """(print, text), each print once at most for every partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches, "text", 1 << 20):
            data, offsets = utf8(batch.column("text"))
            starts, ends, first = word_spans(data, offsets)
            words = word_hashes(data, starts, ends)
            own, take = [], []
            for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
                p = hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest()
                if p not in seen:
                    seen.add(p)
                    own.append(p)
                    take.append(k)
            yield pa.record_batch([pa.array(own, pa.binary()), batch.column("text").take(pa.array(take, pa.int64()))], ["print", "text"])

    return docs.select(docs[text_col].alias("text")).mapInArrow(run, "print binary, text string")


def bag(text: str | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    _, _, hashes, rows = shingles(pa.array([text or ""]), size)
    h, _, c = counted(hashes, rows)
    return h, c


def similarity(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: common occurrences against all."""
    (h, c), (g, d) = one, two
    at = np.minimum(np.searchsorted(h, g), max(0, len(h) - 1))
    same = h[at] == g if len(h) else np.zeros(len(g), bool)
    common = int(np.minimum(c[at[same]], d[same]).sum())
    return common / max(1, int(c.sum() + d.sum()) - common)


def _judged(pairs: DataFrame, size: int, least: float) -> DataFrame:
    """(a, b, alike, n) of the pairs (a, b, text_a, text_b): whether they are similar enough, and how many shingles b has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for batch in batches:
            alike, n = [], []
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True):
                if a != last:
                    last, held = a, bag(x.as_py(), size)
                other = bag(y.as_py(), size)
                alike.append(similarity(held, other) >= least)
                n.append(int(other[1].sum()))
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(alike, pa.bool_()), pa.array(n, pa.int64())], ["a", "b", "alike", "n"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, alike boolean, n long")


def occurrences(texts: DataFrame, size: int) -> DataFrame:
    """(print, n, delta) of (print, text): the shingles of a text, the j-th occurrence of one as an element of its own, so that common elements are common occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            _, _, hashes, rows = shingles(batch.column("text"), size)
            h, r, c = counted(hashes, rows)
            flat = mix(np.repeat(h, c) + (np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)).astype(np.uint64) * _STEP).view(np.int64)
            n = np.bincount(r, c, batch.num_rows).astype(np.int64)
            yield pa.record_batch([batch.column("print"), pa.array(n), lists(flat, np.concatenate([[0], np.cumsum(n)]))], ["print", "n", "delta"])

    return texts.select("print", "text").mapInArrow(run, "print binary, n long, delta array<long>")


# A pair of texts of n and m occurrences, of which `apart` are in one of both only, is similar enough if n + m - apart >= least * (n + m + apart). Taking the same set out of both texts and putting in what they lack of it (the symmetric difference, `delta`) leaves `apart` as it is.


def _within(groups: DataFrame, least: float) -> DataFrame:
    """(a, b) of all similar pairs with different roots within each group (group, print, root, n, delta) of bounded size, by products of occurrence matrices."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        total, n = np.array([len(x) for x in table["delta"]]), table["n"].to_numpy().astype(np.float64)
        ids, place = np.unique(np.concatenate([np.asarray(x, np.int64) for x in table["delta"]]), return_inverse=True)
        row, common = np.repeat(np.arange(len(total)), total), np.zeros((len(total), len(total)))
        twice = np.bincount(place, minlength=len(ids)) > 1  # an element of one text alone is common to no pair
        row, place = row[twice[place]], (np.cumsum(twice) - 1)[place[twice[place]]]
        order = np.argsort(place, kind="stable")
        row, place = row[order], place[order]
        for low in range(0, int(twice.sum()), 8192):
            a, b = np.searchsorted(place, (low, low + 8192))
            x = np.zeros((len(total), int(place[b - 1]) + 1 - low), np.float32)
            x[row[a:b], place[a:b] - low] = 1
            common += x @ x.T
        both, apart = n[:, None] + n[None, :], total[:, None] + total[None, :] - 2 * common
        root = table["root"].to_numpy()
        i, j = np.nonzero(np.triu(both - apart >= least * (both + apart), 1))
        differ = root[i] != root[j]
        own = table["print"].to_numpy()
        return pd.DataFrame({"a": own[i[differ]], "b": own[j[differ]]})

    return groups.select("group", "print", "root", "n", "delta").groupBy("group").applyInPandas(run, "a binary, b binary")


def _refined(rows: DataFrame, least: float, often: int = 64, classes: int = 8) -> tuple[DataFrame, DataFrame]:
    """One step on groups (group, m, print, root, n, delta) too large to be compared pair by pair: links (a, b), and smaller groups of the same columns that hold every similar pair which the links and roots leave open.

    Each group's consensus, the elements of more than half of its members, is taken out of all of them, which leaves what sets them apart. A member's lack is how many elements of its rest it would have to share with another of no lack to be similar to it; a pair is similar if it shares as many as both lack. Members that lack nothing together with the one of the least lack, the hub, are linked to it. Any other similar pair shares an element among the first of each in any common order (the prefix filter): rare elements come first, those in more than one of `often` rests last. How long the prefixes are hangs on both lacks, so members meet by classes of their lack. Each element of a prefix, with the two classes, names a group of the next step. An element is in half of the rests at most, so groups halve at least and the steps end.
    The work of a step is linear in its rows. Consensus and frequent elements are of bounded number for each group: at most 2 and `often` times the mean length of a member's list.
    """
    seen = rows.select("group", "m", F.explode("delta").alias("e")).groupBy("group", "e").agg(F.first("m").alias("m"), F.count("*").alias("c"))
    rest = F.least("c", F.col("m") - F.col("c"))  # in so many rests
    consensus = seen.where(F.col("c") * 2 > F.col("m")).groupBy("group").agg(F.collect_list("e").alias("consensus"))
    hot = seen.where(rest * often > F.col("m")).groupBy("group").agg(F.sort_array(F.collect_list(F.struct(rest.alias("rest"), "e")))["e"].alias("hot"))
    none = F.array().cast("array<bigint>")
    sizes = rows.select("group").distinct()
    facts = stored(sizes.join(consensus, "group", "left").join(hot, "group", "left").select("group", F.coalesce("consensus", none).alias("consensus"), F.coalesce("hot", none).alias("hot")))
    delta = F.array_union(F.array_except("delta", "consensus"), F.array_except("consensus", "delta"))
    apart = rows.join(facts, "group").select("group", "m", "print", "root", "n", delta.alias("delta"), "hot")
    apart = apart.withColumn("delta", F.concat(F.sort_array(F.array_except("delta", "hot")), F.array_intersect("hot", "delta"))).drop("hot")
    apart = stored(apart.withColumn("d", F.size("delta")).withColumn("lack", (F.col("d") * (1 + least) - F.col("n") * (1 - least)) / (2 * (1 + least))))

    hubs = apart.groupBy("group").agg(F.min(F.struct("lack", "print", "root", "n", "d")).alias("hub"), F.max("lack").alias("high"))
    led = apart.join(hubs, "group")
    both, most, own = F.col("n") + F.col("hub.n"), F.col("d") + F.col("hub.d"), F.col("print") == F.col("hub.print")
    led = led.withColumn("linked", own | (both - most >= least * (both + most)))
    links = led.where(F.col("linked") & ~own).select(F.col("hub.print").alias("a"), F.col("print").alias("b"))
    low = F.col("hub.lack")
    width = F.greatest(F.lit(1.0), (F.col("high") - low) / classes)
    led = led.withColumn("low", low).withColumn("width", width).withColumn("class", F.when(F.col("linked"), -1).otherwise(F.floor((F.col("lack") - low) / width)).cast("int"))
    led = led.withColumn("root", F.when(F.col("linked"), F.col("hub.root")).otherwise(F.col("root")))

    def prefix(other: Column) -> Column:
        """So many elements must take part against members of the class `other`, the linked ones if it is -1."""
        least_lack = F.when(other < 0, F.col("low")).otherwise(F.greatest(F.col("low") + other * F.col("width"), -F.col("low")))
        return F.col("d") + 1 - F.greatest(F.lit(1), F.ceil(F.col("lack") + least_lack - 1e-6))

    spread = led.select(F.col("group").alias("was"), "print", "root", "d", "lack", "low", "width", "class", F.posexplode(F.slice("delta", F.lit(1), F.greatest(F.lit(0), prefix(F.lit(-1))).cast("int"))).alias("pos", "e"))
    spread = spread.withColumn("key", F.xxhash64("was", "e")).drop("e")
    again = spread.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    met = spread.join(again, "key")
    met = met.select("was", "print", "root", "key", "class", "pos", "d", "lack", "low", "width", F.explode(F.sequence(F.lit(-1), F.lit(classes))).alias("other"))
    met = met.where((F.col("pos") < prefix(F.col("other"))) & ((F.col("class") >= 0) | (F.col("other") >= 0)))
    keys = stored(met.select("was", "print", "root", "d", "class", (F.col("class") == F.col("other")).alias("same"), F.xxhash64("key", F.least("class", "other"), F.greatest("class", "other")).alias("group")))
    open_ = keys.groupBy("group").agg(F.min("root").alias("from"), F.max("root").alias("to"), F.bool_or("same").alias("same"), F.min("class").alias("first"), F.max("class").alias("last"), F.count("*").alias("m"), F.sum("d").alias("mass"))
    open_ = open_.where("from != to and (same or first != last)").select("group", "m", "mass")
    kept = keys.drop("class", "same", "d").join(open_, "group")
    smaller = kept.join(apart.select(F.col("group").alias("was"), "print", "n", "delta"), ["was", "print"]).select("group", "m", "mass", "print", "root", "n", "delta")
    return stored(links), stored(smaller)


def _settled(rest: DataFrame, least: float, block: int, elements: int) -> DataFrame:
    """(a, b): links that join all similar pairs with different roots within each group (group, m, mass, print, root, n, delta), of any size: those of up to `block` members and `elements` elements (or of 16 members) by a matrix product, larger ones by _refined(). mass: the elements of a group's members together."""
    small = (F.col("m") <= 16) | (F.col("m") <= block) & (F.col("mass") <= elements)
    out, rows = _within(rest.where(small), least), rest
    while True:
        large = stored(rows.where(~small))
        if large.isEmpty():
            return out
        links, rows = _refined(large, least)
        out = out.unionByName(links).unionByName(_within(rows.where(small), least))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8, bands: int = 24, per_band: int = 5, block: int = 2048, elements: int = 1 << 22, chunk: int = 256) -> DataFrame:
    """Per row of docs: its id, class_id, the least id of its class, and copies, the number of rows with the same words. A class holds equal texts, texts that share at least `least` of their word shingles (multisets of `size` whitespace-separated words, unchanged), and what such links join.

    Copies fall together by a fingerprint of their words before anything else, so a text that occurs a million times is signed, compared and linked once. With 24 bands of 5 a pair at 0.8 shares no band, and is missed, with probability 7e-5, and less above. A lower `least` needs shorter bands: 40 of 3 miss a pair at 0.6 with probability 6e-5.
    Texts that share a band are compared in two steps. First each with the band's leader, its member with the most band mates, which for a family of copies is the common original; a leader's text is sent once for `chunk` comparisons. Then, where those that a leader leads still have several components, with each other: up to `block` texts of `elements` shingles together by a matrix product, a row a text; more by _refined(), whose rows grow in proportion to the texts. No link is given up. Components come from star contractions. What is read more than once is written first, so that no plan makes it again and all plans stay small, as the driver holds them. What is written on the way is removed, but for the two tables that the result reads. Band keys and fingerprints that hold over a thousandth of all rows are joined by broadcast of ids, under a thousand of them; see skew.joined(). Later joins of links with what is known of each leader, group, node or root spread its links over tasks; see skew.with_facts().
    Null or empty text: all texts without words are copies of each other. Texts of fewer words than a shingle match only their equals. Null ids: the class takes the least other id, null if there is none. Repeated rows: one result each. Empty table: no rows. Other columns aren't read.
    """
    with tidied(docs.sparkSession) as kept:
        known = stored(prints(docs, id_col, text_col, size, bands, per_band))
        nodes = stored(known.groupBy("print").agg(F.first("bands").alias("bands"), F.min("id").alias("least"), F.count("*").alias("copies")))
        total = known.count()
        each = nodes.select("print", F.explode("bands").alias("key"))
        shared = stored(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
        members = stored(joined(each, shared, "key", "n", total * bands))
        mates = members.groupBy("print").agg(F.sum("n").alias("mates"))
        texts = stored(printed_texts(docs, text_col).join(mates.select("print"), "print", "left_semi").groupBy("print").agg(F.first("text").alias("text")))
        leaders = stored(members.join(mates, "print").groupBy("key").agg(F.max(F.struct("mates", "print"))["print"].alias("a"), F.count("*").alias("held")))
        pairs = stored(joined(members, leaders, "key", "held", total * bands).where("print != a").select("a", F.col("print").alias("b")).distinct())
        held = pairs.groupBy("a").agg(F.count("*").alias("held"))
        parts = F.ceil(F.col("held") / chunk).cast("int")
        salted = stored(with_facts(pairs, "a", "b", F.count("*").alias("held")).select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("salt")))
        heads = texts.withColumnRenamed("print", "a").join(held, "a").select("a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"), F.col("text").alias("text_a"))
        judged = stored(_judged(salted.join(texts.select(F.col("print").alias("b"), F.col("text").alias("text_b")), "b").join(heads, ["a", "salt"]), size, least))
        links = judged.where("alike").select("a", "b")

        # What a leader doesn't settle: those that it leads, where some aren't like it.
        led = judged.select(F.col("a").alias("group"), F.col("b").alias("print"), F.when(F.col("alike"), F.col("a")).otherwise(F.col("b")).alias("root"), "n")
        ends = F.min("root").alias("low"), F.max("root").alias("high")
        open_ = with_facts(led, "group", "print", *ends, F.count("*").alias("m"), F.sum("n").alias("mass"), where="low != high")
        rest = stored(open_.drop("n", "low", "high").withColumn("group", F.xxhash64("group")))
        if not rest.isEmpty():
            sets = occurrences(texts.join(rest.select("print").distinct(), "print", "left_semi"), size)
            links = links.unionByName(_settled(stored(rest.join(sets, "print")), least, block, elements))
        roots = components(links)

        firsts = nodes.select("print", "least", "copies")
        linked = stored(roots.withColumnRenamed("node", "print").join(firsts.drop("copies"), "print"))
        classes = stored(with_facts(linked, "root", "print", F.min("least").alias("class_id")).select("print", "class_id"))
        named = stored(firsts.join(classes, "print", "left").select("print", F.coalesce("class_id", "least").alias("class_id"), "copies"))
        kept += [known, named]
    return joined(known.select("id", "print"), named, "print", "copies", total).select(F.col("id").alias(id_col), "class_id", "copies")
