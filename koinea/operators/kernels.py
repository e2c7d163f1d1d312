"""Character alignment and weighted edit distance; the only parts that need Python, as Arrow-batched UDFs.

One aligner serves all three kernels: it takes cost functions, prefers substitution over insertion over
deletion among equals, and returns the distance matrix with the alignment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from koinea.operators.alignment import bound

GAP = "-1"
# The short vowels that cost less to insert.
CHEAP_PHONEMES = frozenset("eoiau")
CHEAP_INSERT = 0.9
LAM, ARTICLE, LAM_PHONEME = "ل", "ال", "l"
PAIR = "array<struct<src:string,tgt:string>>"

Pairs = list[tuple[str, str]]


def align(
    src: Sequence[str],
    tgt: Sequence[str],
    substitute: Callable[[str, str], float],
    insert: Callable[[str], float],
    delete: Callable[[str], float],
    written: Callable[[str], float] | None = None,
) -> tuple[list[list[float]], Pairs]:
    """Distance matrix and alignment; ``written`` is what a deletion adds where it differs from what it is judged by."""
    written = written or delete
    rows = [[0.0]]
    moves = [["" for _ in range(len(tgt) + 1)] for _ in range(len(src) + 1)]
    for j, t in enumerate(tgt, 1):
        rows[0].append(rows[0][-1] + insert(t))
        moves[0][j] = "i"
    for i, s in enumerate(src, 1):
        up = rows[-1]
        row = [up[0] + delete(s)]
        moves[i][0] = "d"
        for j, t in enumerate(tgt, 1):
            best, move = up[j - 1] + substitute(s, t), "s"
            if (x := row[j - 1] + insert(t)) < best:
                best, move = x, "i"
            if up[j] + delete(s) < best:
                best, move = up[j] + written(s), "d"
            row.append(best)
            moves[i][j] = move
        rows.append(row)
    i, j, out = len(src), len(tgt), []
    while i or j:
        move = moves[i][j]
        i, j = i - (move in "sd"), j - (move in "si")
        out.append((GAP if move == "i" else src[i], GAP if move == "d" else tgt[j]))
    return rows, out[::-1]


def letter_phoneme_alignment(word: str, phonemes: str, mapping: Mapping[str, Sequence[str]]) -> Pairs:
    """Letters of word against space-separated phonemes; doubled phonemes then share a letter."""
    target = phonemes.split()
    head = target[: min(len(target) - 1, 3)] if target else []
    silent = ARTICLE in word and LAM_PHONEME not in head
    _, pairs = align(
        word,
        target,
        lambda s, t: 0.0 if t in mapping.get(s, ()) else 1.0,
        lambda t: CHEAP_INSERT if t in CHEAP_PHONEMES else 1.0,
        lambda s: 1.0,
    ) if not silent else _silent_lam(word, target, mapping)
    before: str | None = None
    for k, (letter, phoneme) in enumerate(pairs):
        if phoneme == before and letter == GAP:
            pairs[k] = pairs[k - 1]
        elif phoneme == before and pairs[k - 1][0] == GAP:
            pairs[k - 1] = pairs[k]
        before = phoneme
    return pairs


def _silent_lam(word: str, target: Sequence[str], mapping: Mapping[str, Sequence[str]]) -> tuple[list[list[float]], Pairs]:
    """As above, where the article's lam is not heard: its deletion is judged as 1 but adds -0.001. The first column keeps 1."""
    return align(
        word,
        target,
        lambda s, t: 0.0 if t in mapping.get(s, ()) else 1.0,
        lambda t: CHEAP_INSERT if t in CHEAP_PHONEMES else 1.0,
        lambda s: 1.0,
        lambda s: -0.001 if s == LAM else 1.0,
    )


def spelling_alignment(raw: str, coda: str) -> Pairs:
    """Characters of two spellings with unit costs."""
    return align(raw, coda, lambda s, t: float(s != t), lambda t: 1.0, lambda s: 1.0)[1]


class WeightedDistance:
    """Weighted edit distance between words of two varieties, with affixes taken off.

    costs: (letter, variety, letter, variety) -> scaled cost, 1 where absent. prefixes and suffixes:
    variety -> set of (variety, affix) that may be taken off.
    """

    def __init__(self, costs: Mapping, prefixes: Mapping | None = None, suffixes: Mapping | None = None) -> None:
        self.costs, self.affixes = costs, {"prefix": prefixes or {}, "suffix": suffixes or {}}

    def cost(self, a: str, da: str, b: str, db: str) -> float:
        return self.costs.get((a, da, b, db), 1.0)

    def __call__(self, src: str, tgt: str, d_src: str, d_tgt: str) -> dict:
        src, tgt = src.strip(), tgt.strip()
        a, b = ("CODA" if d == "MSA" else d for d in (d_src, d_tgt))
        rows, pairs = align(
            src,
            tgt,
            lambda s, t: 0.0 if s == t else self.cost(s, a, t, b),
            lambda t: 0.0 if t == " " else self.cost(GAP, a, t, b),
            lambda s: 0.0 if s == " " else self.cost(s, a, GAP, b),
        )
        raw = total = rows[-1][-1]
        n_src, n_tgt = len(src.replace(" ", "")), len(tgt.replace(" ", ""))
        share = total / max(n_src, n_tgt) if max(n_src, n_tgt) else 0.0
        cut_src, cut_tgt = src, tgt
        if share < 0.5 or " " in src or " " in tgt:
            (head, head_side), (tail, tail_side) = affix_spans(pairs)
            if " " in head and len(head) > 1:
                at = head.rfind(" ")
                pair = (src[at + 1 :], tgt) if head_side == "src" else (src, tgt[at + 1 :])
                return self._shorter(pair, d_src, d_tgt, head_side, head[:at])
            if " " in tail and len(tail) > 1:
                gone = tail[tail.find(" ") + 1 :]
                cut = -len(gone) - 1
                pair = (src[:cut], tgt) if tail_side == "src" else (src, tgt[:cut])
                return self._shorter(pair, d_src, d_tgt, tail_side, gone)
            if head and self._allowed("prefix", head, head_side, a, b):
                k, bare = len(head), len(head.replace(" ", ""))
                if head_side == "src":
                    total, cut_src, n_src = total - rows[k][0], f"{src[:k]}#{src[k:]}", n_src - bare
                else:
                    total, cut_tgt, n_tgt = total - rows[0][k], f"{tgt[:k]}#{tgt[k:]}", n_tgt - bare
            if tail and self._allowed("suffix", tail, tail_side, a, b):
                k, bare = len(tail), len(tail.replace(" ", ""))
                if tail_side == "src":
                    total, cut_src, n_src = total - (raw - rows[len(src) - k][-1]), f"{cut_src[:-k]}#{cut_src[-k:]}", n_src - bare
                else:
                    total, cut_tgt, n_tgt = total - (raw - rows[-1][len(tgt) - k]), f"{cut_tgt[:-k]}#{cut_tgt[-k:]}", n_tgt - bare
            share = total / (max(n_src, n_tgt) or 1)
        return {
            "alignment": pairs,
            "distance_before": round(raw, 3),
            "distance_after": round(total, 3),
            "normalized": round(share, 3),
            "tokenized_src": cut_src,
            "tokenized_tgt": cut_tgt,
            "removed_src": [],
            "removed_tgt": [],
        }

    def _shorter(self, pair: tuple[str, str], d_src: str, d_tgt: str, side: str, gone: str) -> dict:
        out = self(*pair, d_src, d_tgt)
        out[f"removed_{side}"] = [*out[f"removed_{side}"], gone]
        return out

    def _allowed(self, kind: str, affix: str, side: str, a: str, b: str) -> bool:
        a, b = ("MSA" if d == "CODA" else d for d in (a, b))
        own, other = (a, b) if side == "src" else (b, a)
        return (own, affix.strip()) in self.affixes[kind].get(other if own == "MSA" else own, ())


def affix_spans(pairs: Pairs) -> tuple[tuple[str, str], tuple[str, str]]:
    """(text, side) of the pure insertions or deletions before the first and after the last exact match.

    Both spans are read left to right; without an exact match both are empty.
    """
    exact = [k for k, (s, t) in enumerate(pairs) if s == t]
    if not exact:
        return ("", ""), ("", "")

    def span(part: Pairs) -> tuple[str, str]:
        text, side = "", ""
        for s, t in part:
            here = "tgt" if s == GAP else "src" if t == GAP else ""
            if not here or (side and here != side):
                break
            text, side = text + (t if here == "tgt" else s), here
        return text, side

    return span(pairs[: exact[0]]), span(pairs[exact[-1] + 1 :])


def _column(f: Callable, kind: str):
    @F.pandas_udf(kind)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([None if x is None or y is None else [{"src": s, "tgt": t} for s, t in f(x, y)] for x, y in zip(a, b, strict=True)])

    return run


def spelling_alignments(raw: Column, coda: Column) -> Column:
    """spelling_alignment() of two columns; null if either is null."""
    return _column(spelling_alignment, PAIR)(raw, coda)


def letter_phoneme_alignments(word: Column, phonemes: Column, mapping: Mapping[str, Sequence[str]]) -> Column:
    """letter_phoneme_alignment() of two columns; null if either is null."""
    known = {k: tuple(v) for k, v in mapping.items()}
    return _column(lambda w, p: letter_phoneme_alignment(w, p, known), PAIR)(word, phonemes)


DISTANCE = f"alignment {PAIR}, distance_before double, distance_after double, normalized double, tokenized_src string, tokenized_tgt string, removed_src array<string>, removed_tgt array<string>"


def weighted_distances(pairs: DataFrame, costs: Mapping, prefixes: Mapping | None = None, suffixes: Mapping | None = None) -> DataFrame:
    """pairs(src, tgt, d_src, d_tgt) with WeightedDistance as struct `result`.

    Each distinct pair is computed once and joined back. costs holds at most letters x varieties
    squared entries and goes to the executors with the task.
    """
    keys = ["src", "tgt", "d_src", "d_tgt"]

    @F.pandas_udf(DISTANCE)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        distance = WeightedDistance(costs, prefixes, suffixes)
        names = [x.split()[0] for x in ("alignment", "distance_before", "distance_after", "normalized", "tokenized_src", "tokenized_tgt", "removed_src", "removed_tgt")]
        for columns in batches:
            found = [distance(*x) for x in zip(*columns, strict=True)]
            for x in found:
                x["alignment"] = [{"src": s, "tgt": t} for s, t in x["alignment"]]
            yield pd.DataFrame(found, columns=names)

    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    unique = pairs.select(*keys).dropna().distinct().repartition(parts, *keys).withColumn("result", run(*keys))
    return pairs.join(unique, keys, "left")


def spelled_pairs(coda: Column, pairs: Column) -> Column:
    """The pairs of a letter alignment that spell the word, one for each letter.

    Walking along the word, a pair whose letter is not the word's at that place is taken out, so that
    insertions and doubled letters go and the word itself is never lost.
    """

    def step(own: Column, k: Column) -> Column:
        fits = F.coalesce(F.get(own, k)["src"] == F.substr(coda, k + 1, F.lit(1)), F.lit(False))
        rest = F.slice(own, k + 2, F.greatest(F.size(own) - k - 1, F.lit(0)))
        return F.when(fits, own).otherwise(F.concat(F.slice(own, F.lit(1), k), rest))

    walked = F.aggregate(F.sequence(F.lit(0), F.length(coda) - 1), pairs, step)
    return F.when(F.length(coda) > 0, F.slice(walked, F.lit(1), F.length(coda)))


def merge_letter_alignments(rows: DataFrame) -> DataFrame:
    """Letter alignments of CODA words in several dialects merged by letter position.

    rows: (coda, dialect, ord, pairs). Gives (coda, position, letter, by_dialect map<string,string>). At
    each position the last row of a dialect (by ord) counts; rows with a null are left out.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.dropna(subset=["coda", "dialect", "pairs"]).repartition(parts, "coda")  # the aggregate below keeps this partitioning
    told = dealt.select("coda", "dialect", "ord", F.transform(spelled_pairs(F.col("coda"), F.col("pairs")), lambda x: x["tgt"]).alias("tgts"))
    listed = told.groupBy("coda").agg(F.array_sort(F.collect_list(F.struct("dialect", "ord", "tgts"))).alias("rows"))

    def place(i: Column) -> Column:
        reach = F.filter("rows", lambda r: F.size(r["tgts"]) > i)
        last = lambda some: F.filter(some, lambda r, k: ~F.coalesce(F.get(some, k + 1)["dialect"] == r["dialect"], F.lit(False)))
        return F.map_from_entries(F.transform(bound(reach, last), lambda r: F.struct(r["dialect"], F.when(r["ord"].isNotNull(), F.get(r["tgts"], i)))))

    longest = F.array_max(F.transform("rows", lambda r: F.size(r["tgts"])))
    places = F.transform(F.when(longest > 0, F.sequence(F.lit(0), longest - 1)), place)
    # outer, as a plain posexplode adds a filter that works all of this out once more, before words are dealt
    merged = listed.select("coda", F.posexplode_outer(places).alias("position", "by_dialect")).where("position is not null")
    return merged.select("coda", "position", F.substr("coda", F.col("position") + 1, F.lit(1)).alias("letter"), "by_dialect")
