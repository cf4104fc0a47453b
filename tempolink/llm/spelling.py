"""Spelling variants: words of a corpus that differ by one code point, and the form each goes back to.

Words are counted by document, summed in each task before they move. Two near words share the first
half of the shorter one, or else its second half. So a word is sent to the group of its first half,
and, reversed, to that of its second half; to both halves' lengths where it may be the shorter or
the longer word of a pair. A task turns the words of some groups into a minimal acyclic automaton,
one for words read forward and one for those read backward, whose states count the words behind
them, so that a path gives a word's number, and the number its occurrences. A word then walks its
half exactly and completes the rest with one error. A pair whose first halves agree belongs to the
forward automaton, any other to the backward one: so nothing is found twice.

A group with more entries than a task should hold is divided: its pairs agree on half of what is
open, or else on the other half, so both are fixed in turn, and a pair again belongs to the first
where it agrees. That ends with one open code point at the latest, whatever the words.

Forms are followed to the last one by pointer jumping over the words that have one.

Cases: a null or empty text has no words; a null id counts as an empty one; repeated rows count
again; an empty table gives no rows; ties of count go to the smallest word in code-point order; a
very long text is one document, and a very long word one word. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, materialise, parts_for, texts_of

#: Words that a task counts before it passes them on.
HELD = 1 << 19
#: A deletion is made where this divides the hash of a document's word.
EVERY = 31


@dataclass(frozen=True)
class Rule:
    """Words of at least `length` code points and `times` occurrences; a form has at least `ratio`
    times as many."""

    length: int = 7
    times: int = 2
    ratio: int = 10


@dataclass(frozen=True)
class Limits:
    """Entries of a group beyond which it is divided, and entries of an automaton."""

    group: int = 1 << 15
    automaton: int = 1 << 15


def counted_words(docs: DataFrame, rule: Rule) -> DataFrame:
    """word, n: words of the corpus with their occurrences."""
    least = rule.length
    found = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def batch(counts: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), texts_of(b.column("text")), strict=True):
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                # bytes know A-Z alone
                for word, n in Counter(found.findall(text.encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % EVERY == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    counts[word] += n
                if len(counts) > HELD:
                    yield batch(counts)
                    counts = Counter()
        yield batch(counts)

    made = docs.mapInArrow(run, "word string, n long")
    return made.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rule.times)


class Automaton:
    """Minimal acyclic automaton of sorted distinct words; a word's number is its place among them.

    `arcs[state]` has for each letter the next state and how many words come before those behind it.
    """

    def __init__(self, words: list[str]) -> None:
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        self.known: dict[tuple, int] = {}
        #: letters and next states of the states on the last word's path, and whether they are final
        path: list[tuple[list[str], list[int]]] = [([], [])]
        ends, last = [False], ""
        for word in words:
            same, most = 0, min(len(last), len(word))
            while same < most and last[same] == word[same]:
                same += 1
            self._settle(path, ends, last, same)
            for c in word[same:]:
                path[-1][0].append(c)
                path.append(([], []))
                ends.append(False)
            ends[-1] = True
            last = word
        self._settle(path, ends, last, 0)
        self.start = self._state(path[0], ends[0])
        self.known.clear()

    def _settle(self, path: list, ends: list[bool], last: str, depth: int) -> None:
        """Make the states of the last word's path beyond a depth final for good."""
        while len(path) > depth + 1:
            state = self._state(path.pop(), ends.pop())
            path[-1][1].append(state)

    def _state(self, out: tuple[list[str], list[int]], end: bool) -> int:
        key = (end, *out[0], *out[1])
        state = self.known.get(key)
        if state is None:
            state = self.known[key] = len(self.arcs)
            before = list(accumulate((self.size[t] for t in out[1]), initial=int(end)))
            self.arcs.append(dict(zip(out[0], zip(out[1], before, strict=False), strict=True)))
            self.final.append(end)
            self.size.append(before[-1])
        return state

    def rest(self, state: int, number: int, word: str, at: int) -> int:
        """The number of the word that ends as `word` does from `at` on; -1 if there is none."""
        arcs = self.arcs
        for k in range(at, len(word)):
            step = arcs[state].get(word[k])
            if step is None:
                return -1
            state = step[0]
            number += step[1]
        return number if self.final[state] else -1

    def near(self, word: str, fixed: int, closed: int = 0) -> set[int]:
        """Numbers of words that replace or insert one letter of `word`, but for the first `fixed`
        and the last `closed` ones."""
        arcs, found = self.arcs, set()
        state, number = self.start, 0
        length, last = len(word), len(word) - closed
        for at in range(last + 1):
            here = arcs[state]
            own = word[at] if at < length else ""
            if at >= fixed:
                for c, (to, skip) in here.items():
                    if c != own and at < last:
                        found.add(self.rest(to, number + skip, word, at + 1))
                    found.add(self.rest(to, number + skip, word, at))
            step = here.get(own)
            if step is None:
                break
            state, number = step[0], number + step[1]
        found.discard(-1)
        return found


def near_in_groups(batches: Iterator[pa.RecordBatch], rule: Rule, most: int) -> Iterator[pa.RecordBatch]:
    """For words of some groups, sorted by group: near words found, how many, and of the most frequent
    of them its count and itself."""
    held: dict[bool, list[tuple]] = {False: [], True: []}
    n, last = 0, None

    def settle() -> pa.RecordBatch:
        count: Counter[str] = Counter()
        best: dict[str, tuple[int, str]] = {}

        def put(word: str, near: str, times: int) -> None:
            count[word] += 1
            best[word] = min(best.get(word, (1, "")), (-times, near))

        for back, entries in held.items():
            occurs = {e[0]: e[1] for e in entries}
            words = sorted(occurs)
            automaton, times = Automaton(words), [occurs[w] for w in words]
            for word, own, asks, fixed, closed, apart in entries:
                if not asks:
                    continue
                plain = word[::-1] if back else word
                half = len(word) // 2
                for k in automaton.near(word, fixed, closed):
                    other = words[k]
                    shown = other[::-1] if back else other
                    if (back and plain[:half] == shown[:half]) or (apart and word[:apart] == other[:apart]):
                        continue  # it belongs to another group
                    put(plain, shown, times[k])
                    if len(other) > len(word):
                        put(shown, plain, own)
            entries.clear()
        words = list(count)
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array([count[w] for w in words], pa.int64()), pa.array([-best[w][0] for w in words], pa.int64()), pa.array([best[w][1] for w in words], pa.string())],
            ["word", "n_near", "form_n", "form"],
        )

    for b in batches:
        columns = (b.column(c).to_pylist() for c in ("key", "back", "word", "n", "asks", "fixed", "closed", "apart"))
        for key, back, *entry in zip(*columns, strict=True):
            if n >= most and key != last:
                yield settle()
                n = 0
            held[back].append(tuple(entry))
            n, last = n + 1, key
    yield settle()


def key_of(*more: Column) -> Column:
    """The group of words, read forward or backward, that agree in what is fixed."""
    return F.xxhash64("back", F.substring("word", F.lit(1), F.col("fixed")), *more)


def halves(words: DataFrame, rule: Rule) -> DataFrame:
    """key, back, word (reversed if so), n, asks, fixed, closed, apart: every word in the groups of its
    halves, as the shorter word of a pair, where it asks, and as the longer one."""
    length = F.length("word")
    first = F.array_distinct(F.array(F.expr("length(word) div 2"), F.expr("(length(word) - 1) div 2")))
    second = F.array_distinct(F.array(F.expr("(length(word) + 1) div 2"), F.expr("length(word) div 2")))
    fore = words.select(F.lit(False).alias("back"), "word", "n", F.explode(first.cast("array<int>")).alias("fixed"))
    fore = fore.where(F.col("fixed") >= rule.length // 2).withColumn("asks", F.col("fixed") == F.expr("length(word) div 2"))
    back = words.select(F.lit(True).alias("back"), F.reverse("word").alias("word"), "n", F.explode(second.cast("array<int>")).alias("fixed"))
    back = back.where(F.col("fixed") >= (rule.length + 1) // 2).withColumn("asks", F.col("fixed") == F.expr("(length(word) + 1) div 2"))
    made = fore.unionByName(back).withColumns({"closed": F.lit(0), "apart": F.lit(0), "shorter": F.lit(None).cast("int")})
    return made.withColumn("key", key_of()).withColumn("length", length)


def divided(entries: DataFrame) -> DataFrame:
    """Entries of large groups in the groups that fix half of what is open. A word that stood for two
    lengths of the shorter word of a pair has an entry for each from here on."""
    whole = F.expr("CASE WHEN back THEN (length + 1) div 2 ELSE length div 2 END")
    less = F.expr("CASE WHEN back THEN length div 2 ELSE (length - 1) div 2 END")
    roles = F.filter(F.array(F.when(F.col("fixed") == whole, F.col("length")), F.when(F.col("fixed") == less, F.col("length") - 1)), lambda x: x.isNotNull())
    now = entries.withColumn("shorter", F.explode(F.when(F.col("shorter").isNotNull(), F.array("shorter")).otherwise(roles)))
    now = now.withColumn("asks", F.col("shorter") == F.col("length")).withColumn("open", F.col("shorter") - F.col("fixed") - F.col("closed"))
    middle = F.col("fixed") + F.expr("open div 2")
    first = F.struct(middle.alias("fixed"), F.col("closed").alias("closed"), F.col("apart").alias("apart"))
    second = F.struct(F.col("fixed").alias("fixed"), (F.col("shorter") - middle).alias("closed"), middle.alias("apart"))
    now = now.withColumn("side", F.explode(F.array(first, second)))
    now = now.withColumns({c: F.col(f"side.{c}").cast("int") for c in ("fixed", "closed", "apart")}).drop("side", "open")
    return now.withColumn("key", key_of(F.substring("word", F.col("length") - F.col("closed") + 1, F.col("closed")), F.col("shorter"), F.col("apart")))


def grouped(words: DataFrame, rule: Rule, limits: Limits) -> DataFrame:
    """The entries of all groups, none larger than a task should hold unless one code point is open."""
    entries, done = halves(words, rule), []
    while True:
        open_ = F.col("shorter").isNull() | (F.col("shorter") - F.col("fixed") - F.col("closed") > 1)
        large = entries.where(open_).groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > limits.group).select("key")
        large = materialise(large, "large")
        if large.isEmpty():
            done.append(entries)
            break
        done.append(entries.join(large, "key", "left_anti"))
        entries = materialise(divided(entries.join(large, "key", "left_semi")), "halves")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root: where forms lead. Each turn doubles the steps taken."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        jump = now.select(F.col("word").alias("root"), F.col("root").alias("after"))
        after = materialise(now.join(jump, "root", "left").select("word", F.coalesce("after", "root").alias("root"), F.col("after").isNotNull().alias("moved")), "roots")
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """word, form, root, n, n_near, form_n for every word of the corpus."""
    spark = docs.sparkSession
    words = materialise(counted_words(id_and_text(docs, id_col, text_col), rule), "words")
    size = 4 * words.count()
    entries = grouped(words, rule, limits).select("key", "back", "word", "n", "asks", "fixed", "closed", "apart")
    dealt = entries.repartition(parts_for(spark, size, 4 * limits.automaton), "key").sortWithinPartitions("key")
    found = dealt.mapInArrow(lambda b: near_in_groups(b, rule, limits.automaton), "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    summed = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    follows = -F.col("best.less") >= rule.ratio * F.col("n")
    near = words.join(summed, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(follows, F.col("best.form")).alias("form"), F.when(follows, -F.col("best.less")).alias("form_n")
    )
    near = materialise(near, "near")
    roots = last_forms(near.where("form is not null"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
