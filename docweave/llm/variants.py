"""Grouping of spelling variants by finite-state composition (operator 11).

The words of a group form a minimised acyclic acceptor. Composed with a one-edit transducer and the acceptor again, it
accepts exactly the pairs of words one edit apart. As long as nothing is edited both sides stand in the same state, so
the composed machine splits by that state: words that share a prefix are one partition, and its pairs are enumerated in
one task. An edit is taken at the first difference only, so each pair has one path; composed states from which no
common rest is left are remembered as dead.

A prefix that too many words share is not composed as a whole. Its own edit arcs are peeled off: words that are equal
but for the character after the prefix (or have none there) meet under the rest that both sides still have to read, at
most one word per character. Everything behind the prefix belongs to the longer prefixes. No group of words is
unbounded, and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.shared import Store

GROUP_WORDS = 10_000
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEPTHS = 8  # prefix lengths counted at once


class Acceptor:
    """The minimal acyclic automaton of sorted distinct words: `final` and `arcs` (character to state) by state."""

    def __init__(self, words: list[str], skip: int = 0):
        self.final, self.arcs, self.known = [], [], {}
        path, last = [[False, {}]], ""  # open states along the last word
        for word in words:
            word = word[skip:]
            shared = 0
            while shared < min(len(last), len(word)) and last[shared] == word[shared]:
                shared += 1
            self._close(path, last, shared)
            path += [[False, {}] for _ in range(len(word) - shared)]
            path[-1][0] = True
            last = word
        self._close(path, last, 0)
        self.start = self._state(*path[0])

    def _close(self, path: list, last: str, keep: int) -> None:
        while len(path) > keep + 1:
            final, arcs = path.pop()
            path[-1][1][last[len(path) - 1]] = self._state(final, arcs)

    def _state(self, final: bool, arcs: dict) -> int:
        key = (final, tuple(arcs.items()))
        if key not in self.known:
            self.known[key] = len(self.final)
            self.final.append(final)
            self.arcs.append(arcs)
        return self.known[key]


class Composed:
    """The acceptor composed with one edit and itself; `pairs` enumerates the pairs of words it accepts."""

    def __init__(self, acceptor: Acceptor):
        self.a, self.live = acceptor, {}

    def alive(self, p: int, q: int) -> bool:
        """Whether some rest leads both states to an end."""
        arcs, final, live = self.a.arcs, self.a.final, self.live
        stack = [(p, q)]
        while stack:
            p_, q_ = here = stack[-1]
            if here in live:
                stack.pop()
                continue
            if p_ == q_ or (final[p_] and final[q_]):
                live[here] = True
                continue
            nexts = [(arcs[p_][c], arcs[q_][c]) for c in arcs[p_] if c in arcs[q_]]
            if any(live.get(x) for x in nexts):
                live[here] = True
            elif open_ := [x for x in nexts if x not in live]:
                stack.append(open_[-1])
            else:
                live[here] = False
        return live[p, q]

    def rests(self, p: int, q: int, barred: str | None = None) -> Iterator[str]:
        """The strings that lead both states to an end; the first character is not `barred`."""
        arcs, final = self.a.arcs, self.a.final
        if not self.alive(p, q):
            return
        stack, path = [(p, q, 0, "")], []
        while stack:
            p, q, depth, c = stack.pop()
            del path[max(0, depth - 1) :]
            if depth:
                path.append(c)
            if final[p] and final[q]:
                yield "".join(path)
            for c in arcs[p]:
                if c in arcs[q] and (depth or c != barred) and self.alive(arcs[p][c], arcs[q][c]):
                    stack.append((arcs[p][c], arcs[q][c], depth + 1, c))

    def pairs(self) -> Iterator[tuple[str, str]]:
        """Each pair of words one edit apart, once."""
        arcs, stack = self.a.arcs, [(self.a.start, 0, "")]
        path = []
        while stack:
            state, depth, c = stack.pop()
            del path[max(0, depth - 1) :]
            if depth:
                path.append(c)
            here, out = "".join(path), list(arcs[state].items())
            for i, (c, p) in enumerate(out):
                for rest in self.rests(p, state, barred=c):  # c on one side only
                    yield here + c + rest, here + rest
                for d, q in out[:i]:
                    for rest in self.rests(p, q):
                        yield here + c + rest, here + d + rest
                stack.append((p, depth + 1, c))


def occurrences(docs: DataFrame, spoil: int) -> DataFrame:
    """word, one row per run of letters in every text: lower-cased, one character out where the run's hash says so."""
    text = F.translate("text", UPPER, LOWER)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]+"), F.lit(0))).alias("run"))
    code = F.crc32(F.encode(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")), "UTF-8"))
    at = (code % F.char_length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return runs.select(F.when(code % spoil == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, shortest: int, least: int, spoil: int) -> DataFrame:
    """word, n of the words with at least `shortest` code points and `least` occurrences."""
    words = occurrences(docs, spoil).where(F.char_length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def crowded(words: DataFrame, limit: int, store: Store) -> DataFrame:
    """prefix: those that more than `limit` words share; at most one in `limit` words for each length."""
    found, rest, depth = None, words, 0
    while True:
        lengths = F.sequence(F.lit(depth), F.least(F.lit(depth + DEPTHS - 1), F.char_length("word")))
        prefixes = rest.select("word", F.explode(lengths).alias("length")).select(F.substring("word", F.lit(1), F.col("length")).alias("prefix"))
        more = store.put(prefixes.groupBy("prefix").count().where(F.col("count") > limit).select("prefix"), f"crowded{depth}")
        found = more if found is None else found.unionByName(more)
        last = more.where(F.char_length("prefix") == depth + DEPTHS - 1)
        if last.isEmpty():
            return found
        depth += DEPTHS
        longest = F.substring("word", F.lit(1), F.lit(depth - 1))
        rest = words.where(F.char_length("word") >= depth).join(last, longest == F.col("prefix"), "left_semi")


def near_words(words: DataFrame, store: Store, limit: int = GROUP_WORDS) -> DataFrame:
    """word, n_near, form, form_n: how many words are one edit away, and the one of largest n (ties: the smallest).

    words: (word, n), each word once. Words without a near one are left out.
    """
    hot = crowded(words, limit, store)
    # The prefixes of a crowded one are crowded, so a word's own are those of length 0 to their number less one.
    held = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.char_length("word"))).alias("depth"))
    held = held.join(F.broadcast(hot), F.substring("word", F.lit(1), F.col("depth")) == F.col("prefix"))
    peeled = store.put(held.select("word", "n", "depth"), "peeled")
    depth = peeled.groupBy("word").agg((F.max("depth") + 1).alias("depth"))
    placed = words.join(depth, "word", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    placed = placed.withColumn("prefix", F.substring("word", F.lit(1), F.col("depth")))

    def compose(rows: pa.Table) -> pa.Table:
        prefix = rows.column("prefix")[0].as_py()
        n = dict(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist()))
        best = {}

        def meet(word: str, other: str) -> None:
            count, size, form = best.get(word, (0, 0, ""))
            better = n[other] > size or (n[other] == size and other < form)
            best[word] = (count + 1, n[other], other) if better else (count + 1, size, form)

        if len(n) > 1:
            for left, right in Composed(Acceptor(sorted(n), len(prefix))).pairs():
                left, right = prefix + left, prefix + right
                meet(left, right)
                meet(right, left)
        columns = list(zip(*((w, *x) for w, x in best.items()))) or [[], [], [], []]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.table({c: pa.array(x, k) for c, x, k in zip(("word", "n_near", "form_n", "form"), columns, kinds)})

    inside = placed.groupBy("prefix").applyInArrow(compose, "word string, n_near long, form_n long, form string")
    every = inside.unionByName(_peeled(peeled))
    best = F.min_by(F.struct("form", "form_n"), F.struct(-F.col("form_n"), F.col("form"))).alias("best")
    found = every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", "best.form", "best.form_n")


def _peeled(rows: DataFrame) -> DataFrame:
    """The pairs that differ first at `depth`, reduced per word: word, n_near, form_n, form.

    `rest` is what both sides read: the word without its character there, or the whole word as the shorter side. A pair
    of unequal lengths counts where the next character is not the one left out, so each is met at one depth only.
    """
    at = F.col("depth")
    out = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
    cut = rows.where(F.char_length("word") > at).withColumns({"rest": out, "letter": F.substring("word", at + 1, F.lit(1))})
    whole = rows.withColumns({"rest": F.col("word"), "letter": F.lit("")})
    item = F.struct((-F.col("n")).alias("less"), F.col("word"), F.col("letter"))
    groups = cut.unionByName(whole).groupBy("depth", "rest").agg(F.sort_array(F.collect_list(item)).alias("held"))
    groups = groups.where(F.size("held") > 1).withColumn("next", F.substring("rest", at + 1, F.lit(1)))
    each = groups.withColumn("me", F.explode("held"))

    def meets(x):
        apart = (x["letter"] != "") & (F.col("me.letter") != "")
        return (x["word"] != F.col("me.word")) & (apart | (F.concat(x["letter"], F.col("me.letter")) != F.col("next")))

    near = F.filter("held", meets)
    found = each.select(F.col("me.word").alias("word"), F.size(near).cast("long").alias("n_near"), F.get(near, F.lit(0)).alias("first"))
    return found.where("n_near > 0").select("word", "n_near", (-F.col("first.less")).alias("form_n"), F.col("first.word").alias("form"))


def roots(forms: DataFrame, store: Store) -> DataFrame:
    """word, root: where following `form` from word to word ends. Each step multiplies n, so few doublings reach it."""
    found, turn = store.put(forms.select("word", F.col("form").alias("root")), "roots0"), 0
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = store.put(found.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"roots{turn + 1}")
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        found, turn = after.drop("moved"), turn + 1


def variants(
    docs: DataFrame, shortest: int = 7, least: int = 2, times: int = 10, spoil: int = 31, limit: int = GROUP_WORDS
) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of at least `shortest` code points and `least` occurrences.

    Reads doc_id and text, other columns are ignored. Words are runs of letters, A-Z as a-z; a run whose hash with its
    document's id divides by `spoil` loses one character first. `form` is the word one edit away that occurs most often
    (ties: the smallest by code points), if it does so `times` as often, else null; `root` is the end of the chain of
    forms. A null or empty text has no words; the runs of a row without id have no hash and stay as they are; rows that
    repeat count each; an empty table gives no rows. A group's task holds some 300 bytes per character of its words.
    """
    store = Store(docs.sparkSession, "variants")
    words = store.put(vocabulary(docs, shortest, least, spoil), "words")
    near = words.join(near_words(words, store, limit), "word", "left")
    close = F.col("form_n") >= times * F.col("n")
    judged = near.select(
        "word", F.when(close, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(close, F.col("form_n")).alias("form_n"),
    )
    judged = store.put(judged, "forms")
    ends = roots(judged.where("form IS NOT NULL"), store)
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# The same in SQL: the hash by a table of its 256 steps and a recursion over byte positions, near words by the words that
# one character left out has in common.
ORACLE_SQL = """
WITH RECURSIVE steps(i, k, v) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, xor(v >> 1, 3988292384 * (v & 1)) FROM steps WHERE k < 8),
lookup AS (SELECT i, v FROM steps WHERE k = 8),
runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
    FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT *, hex(encode(doc_id || ':' || run)) AS digits, row_number() OVER () AS id FROM runs),
crc(id, pos, v) AS (
  SELECT id, 0, 4294967295 FROM hashed
  UNION ALL
  SELECT c.id, c.pos + 1, xor(c.v >> 8, l.v) FROM crc c JOIN hashed h ON h.id = c.id AND c.pos < length(h.digits) // 2
  JOIN lookup l ON l.i = xor(c.v, ('0x' || substr(h.digits, 2 * c.pos + 1, 2))::BIGINT) & 255),
marked AS (
  SELECT h.run, h.times, xor(c.v, 4294967295) AS code FROM hashed h JOIN crc c ON c.id = h.id AND c.pos = length(h.digits) // 2),
words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT times, CASE WHEN code % 31 = 0 THEN left(run, CAST(code % length(run) AS INT)) || substr(run, CAST(code % length(run) AS INT) + 2) ELSE run END AS word
    FROM marked) WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
cut AS (SELECT word, n, i, left(word, CAST(i - 1 AS INT)) || substr(word, CAST(i + 1 AS INT)) AS rest FROM words, unnest(range(1, length(word) + 1)) u(i)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
judged AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form,
    CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
chain(word, root) AS (
  SELECT word, word FROM judged UNION ALL SELECT c.word, j.form FROM chain c JOIN judged j ON j.word = c.root WHERE j.form IS NOT NULL)
SELECT j.word, j.form, c.root, j.n, j.n_near, j.form_n
FROM judged j JOIN chain c ON c.word = j.word JOIN judged r ON r.word = c.root AND r.form IS NULL
"""
