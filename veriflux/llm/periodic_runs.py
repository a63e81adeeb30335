"""Periodic runs of words (maximal repetitions), by Kolpakov and Kucherov's method.

A run is a stretch of words with smallest period q, at least 2 * q long, that no
neighbour extends. Each text is one row's work:
1. A run's words are covered by six-word strings that stand twice in the text
   (both parts of a run that are q apart are at least six words long). Words
   that are not covered can be in no run; what is left are separate stretches.
2. A suffix automaton of a stretch, with the first end of each state, gives its
   LZ factors: the longest string that began earlier, or a new word.
3. Main's algorithm finds the runs that touch a factor's edge, from the longest
   common extensions to both sides of the edge for every period at once.
4. A run strictly inside a factor stands in its earlier occurrence too, and is
   copied from there, factors from left to right.
All steps take time linear in the stretch.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MIX_A, mix64, small_text_batches

#: The shortest run; a shorter one than 2 * GRAM words would not be covered by strings of GRAM words.
LEAST, GRAM = 12, 6
#: Texts are numbered together up to so many bytes.
GROUP_BYTES = 4 << 20
WORD = r"[^\x20\x09-\x0D]+"
#: Parts of the planted repetitions of op11's contract.
ONE_IN, FEWEST, MORE = 10, 3, 8

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.binary())])


def factors(w: list[int]) -> list[tuple[int, int]]:
    """(start, start of an earlier occurrence or -1) of each LZ factor of w; an occurrence may reach into the factor.

    A state of the suffix automaton has its first transition in two arrays; the
    few states with several have a dictionary for the others.
    """
    word, target, link, length, first = array("q", [-1]), array("q", [0]), array("q", [-1]), array("q", [0]), array("q", [-1])
    more: dict[int, dict[int, int]] = {}
    last = 0
    for i, c in enumerate(w):
        new = len(link)
        word.append(-1), target.append(0), link.append(0), length.append(i + 1), first.append(i)
        p, q = last, -1
        while p >= 0:
            if word[p] < 0:
                word[p], target[p] = c, new
            elif word[p] == c:
                q = target[p]
                break
            else:
                others = more.setdefault(p, {})
                if c in others:
                    q = others[c]
                    break
                others[c] = new
            p = link[p]
        if q >= 0:
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(link)
                word.append(word[q]), target.append(target[q]), link.append(link[q]), length.append(length[p] + 1), first.append(first[q])
                if q in more:
                    more[twin] = dict(more[q])
                while p >= 0:
                    if word[p] == c:
                        if target[p] != q:
                            break
                        target[p] = twin
                    elif p in more and more[p].get(c) == q:
                        more[p][c] = twin
                    else:
                        break
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    out, i, n = [], 0, len(w)
    while i < n:
        state, k = 0, i
        while k < n:
            c = w[k]
            to = target[state] if word[state] == c else more[state][c]
            if first[to] >= k:  # its first occurrence is this one
                break
            state, k = to, k + 1
        out.append((i, first[state] - (k - i) + 1 if k > i else -1))
        i = max(k, i + 1)
    return out


def extensions(s: list[int]) -> list[int]:
    """For each place, how many words from there equal those from the beginning; 0 for the beginning itself."""
    out, lo, hi, n = [0] * len(s), 0, 0, len(s)
    for i in range(1, n):
        k = min(out[i - lo], hi - i) if i < hi else 0
        if i + k >= hi:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            lo, hi = i, i + k
        out[i] = k
    return out


def touching(w: list[int], lo: int, edge: int, hi: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, a period) of maximal repetitions of w with start <= edge <= end, that start after lo and end before hi, or there for good."""
    left, right = w[lo:edge], w[edge:hi]
    a, b = len(left), len(right)
    after = extensions([*right, -1, *left, *right])
    before = extensions([*left[::-1], -1, *right[::-1], *left[::-1]])
    for q in range(1, a + 1):  # q words before the edge
        back, on = before[q] if q < a else 0, after[b + 1 + a - q]
        if back + on >= q and q + back + on >= least:
            yield edge - q - back, edge + on, q
    for q in range(1, b + 1):  # q words after it
        back, on = before[a + 1 + b - q], after[q] if q < b else 0
        if back + on >= q and q + back + on >= least:
            yield edge - back, edge + q + on, q


def runs_of(w: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs of at least `least` words, by start and period."""
    n, found = len(w), {}
    cuts = [*factors(w), (n, -1)]
    for (before, _), (edge, _), (hi, _) in zip(cuts, cuts[1:], [*cuts[2:], (n, -1)]):
        # a run that ends in this factor starts within twice the previous factor and this one's length before it
        lo = max(0, edge - 2 * (edge - before) - (hi - edge))
        for s, e, q in touching(w, lo, edge, hi, least):
            if (e == n or w[e] != w[e - q]) and (s == 0 or w[s - 1] != w[s - 1 + q]):
                found[s, e] = min(q, found.get((s, e), q))  # a multiple of the period gives the same stretch
    by_start: dict[int, list[tuple[int, int]]] = {}
    for (s, e), q in found.items():
        by_start.setdefault(s, []).append((e, q))
    for (start, source), (end, _) in zip(cuts, cuts[1:]):
        shift = start - source
        if source < 0 or end - start < least + 2:
            continue
        for s in range(source + 1, end - shift - least):
            for e, q in by_start.get(s, ()):
                if e + shift < end:
                    by_start.setdefault(s + shift, []).append((e + shift, q))
    return sorted(((s, e - s, q) for s, ends in by_start.items() for e, q in ends), key=lambda r: (r[0], r[2]))


def repeating(ids: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which words are covered by strings of GRAM words that stand twice in their document (a collision of hashes covers more)."""
    covered = np.zeros(len(ids) + 1, np.int32)
    if len(ids) >= GRAM:
        n = len(ids) - GRAM + 1
        h = mix64(doc[:n].astype(np.uint64))
        for k in range(GRAM):
            h = h * MIX_A + ids[k : k + n].astype(np.uint64) + np.uint64(1)
        h = mix64(h)
        at = np.flatnonzero(np.arange(n) + GRAM <= ends[doc[:n]])
        order = np.argsort(h[at])
        same = h[at][order][1:] == h[at][order][:-1]
        at = at[order[np.r_[False, same] | np.r_[same, False]]] if len(at) else at
        covered[at] += 1
        covered[at + GRAM] -= 1
    return np.cumsum(covered)[:-1] > 0


def runs_of_texts(texts: list[list[bytes]], least: int) -> list[list[tuple[int, int, int]]]:
    """runs_of() of each list of words, from its stretches that repeat."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    number = defaultdict(count().__next__)
    ids = np.fromiter((number[x] for t in texts for x in t), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    covered = repeating(ids, doc, ends)
    new = np.r_[True, (covered[1:] != covered[:-1]) | (doc[1:] != doc[:-1])] if len(ids) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    stop = np.r_[begin[1:], len(ids)]
    some = covered[begin] & (stop - begin >= least)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for lo, hi in zip(begin[some].tolist(), stop[some].tolist()):
        i = int(doc[lo])
        offset = lo - int(ends[i] - sizes[i])
        out[i] += [(s + offset, n, q) for s, n, q in runs_of(ids[lo:hi].tolist(), least)]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run has after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    kept, at = [], 0
    for s, e in sorted((s + q, s + n) for s, n, q in runs):
        kept += words[at:s] if s > at else []
        at = max(at, e)
    return b" ".join(kept + words[at:])


def groups(bodies: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    """The words of the texts, so many texts at a time as have GROUP_BYTES, or one."""
    held, size = [], 0
    for body in bodies:
        held.append((body or b"").split())  # bytes.split() cuts at space and \t-\r
        size += len(body or b"")
        if size >= GROUP_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def find(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in groups(batch.column(1).to_pylist()):
                runs = runs_of_texts(texts, least)
                offsets = np.cumsum([0, *map(len, runs)]).astype(np.int32)
                rows = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
                listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c) for c in rows.T], fields=list(RUN)))
                kept = pa.array([collapsed(t, r) for t, r in zip(texts, runs)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([len(t) for t in texts], pa.int64()), listed, kept], schema=FOUND)
                at += len(texts)

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs array<struct<start, length, period>>, collapsed text for every row of docs.

    Words are maximal runs of other than space and \\t-\\r, numbered from 0; runs
    have at least `least` words (12 or more) and come by start, then period.
    collapsed has the words that no run contains after its first period, joined by
    one space. A null or empty text has no words, no runs and an empty collapsed
    text. Every row stands for itself, so repeated rows, ties and null doc_ids
    change nothing; other columns are not read. An empty table gives no rows.
    """
    if least < 2 * GRAM:
        raise ValueError(f"runs of fewer than {2 * GRAM} words are not covered by strings of {GRAM}")
    small_text_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("body"))
    found = rows.mapInArrow(find(least), "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, one text in ten (by crc32 of the id) periodic from some word to its end, as op11's contract has it.

    Null ids and texts without words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h"))
    rows = rows.withColumn("words", F.when(F.col("h") % ONE_IN == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))))
    g, n = F.floor(F.col("h") / ONE_IN), F.size("words")
    rows = rows.withColumn("a", F.when(n > 0, F.pmod(g, n).cast("int"))).withColumn("p", (1 + F.floor((n - F.col("a")) / (FEWEST + g % MORE))).cast("int"))
    again = F.transform("words", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of op11's contract, from those of periodic_runs()."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    longest: Column = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
        F.expr("1000L * longest.length div -longest.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
