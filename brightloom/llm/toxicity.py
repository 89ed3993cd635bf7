"""Toxicity: a lexicon learned from labelled text, misspellings of it, and the context of each hit.

The lexicon holds the words that labelled toxic documents use more often than others, in two separate halves of the
settings (word before, word after) that they stand in; copies of a text share their settings and count once. Terms that
end in ``*`` are stems: any word that begins so is a hit. The trie of the terms, intersected with Levenshtein automata of one
edit from ``SOME_EDITS`` letters and two from ``LONG`` on, is one automaton over words: a state is a set of (trie node,
edits left), found when first reached, and a word leaves it as soon as no term is near. A word near a term is no
misspelling of it where labelled clean texts use it as an ordinary word, and a term whose near words are mostly such ones
(``=`` at its end) is looked for as it stands. A hit counts as abuse or as quotation: a pair of quotation marks around it,
or words of reporting in the window before it. A logistic fit whose weights are never negative turns the numbers of all
hits, of those not quoted, of the exact ones among them, and their share of the words into a score. The fit reads at most
``most`` labelled rows; every text is scored whole.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.functions.runtime import materialise, ship_by_value
from brightloom.llm import labelled
from brightloom.llm.labelled import fold, probability, rising, training_rows
from brightloom.llm.lean import give_back, lean
from brightloom.llm.names import free, own

ship_by_value(labelled.__name__)
ship_by_value(__name__)

MOST_LABELLED = 20_000
SHORTEST, SOME_EDITS, LONG = 2, 4, 9  # letters of the shortest term, of one with an edit, of one with two
WINDOW = 40
FEATURES = 4
STEMS, STEM = (3, 4, 5, 6, 7, 8), -2  # lengths of stems; the state of a word that has begun with one
WORD = re.compile(r"[^\W_]+")
#: Marks that open a quotation, each with those that close it.
PAIRS = {'"': '"', "'": "'", "`": "`'", "“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "‚": "‘’", "‹": "›", "›": "‹"}
MARKS = frozenset("".join(PAIRS) + "".join(PAIRS.values()))
#: Words that announce another's words, in the four languages of the corpus.
REPORTING = frozenset((
    "said says called calls wrote quoted quote word term means "
    "sagte sagt nannte schrieb zitat wort dit appelé écrit cité mot dijo llamó escribió cita palabra"
).split())


class Lexicon:
    """Terms as a trie, read by a Levenshtein automaton whose states are found as words need them."""

    def __init__(self, terms):
        self.next: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]  # edits allowed to the term that ends here, -1 if none ends
        self.allowed: list[int] = [0]  # the most edits of any term below
        self.stem: set[int] = set()
        self.name: dict[int, str] = {}
        for term in sorted(terms):
            stem, edits = term.endswith("*"), 0 if term[-1] in "*=" else self.most_edits(len(term))
            term = term.rstrip("*=")
            at = 0
            self.allowed[0] = max(self.allowed[0], edits)
            for ch in term:
                if ch not in self.next[at]:
                    self.next[at][ch] = len(self.next)
                    self.next.append({})
                    self.term.append(-1)
                    self.allowed.append(0)
                at = self.next[at][ch]
                self.allowed[at] = max(self.allowed[at], edits)
            if stem:
                self.stem.add(at)
            else:
                self.term[at] = edits
                self.name[at] = term
        self.sets: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.best: list[int] = []
        self.ends: list[list[int]] = []
        self.start = self._state({(0, 0)})

    @staticmethod
    def most_edits(letters: int) -> int:
        return 0 if letters < SOME_EDITS else 1 if letters < LONG else 2

    def _state(self, reached) -> int:
        """The number of a set of (node, edits made), closed over letters that the word leaves out; -1 if empty."""
        least: dict[int, int] = {}
        todo = list(reached)
        while todo:
            node, made = todo.pop()
            if made > self.allowed[node] or least.get(node, 9) <= made:
                continue
            least[node] = made
            todo += [(child, made + 1) for child in self.next[node].values()]
        if not least:
            return -1
        if any(made == 0 and node in self.stem for node, made in least.items()):
            return STEM
        key = frozenset(least.items())
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            ends = [(made, node) for node, made in key if made <= self.term[node]]
            self.best.append(min(ends, default=(-1, 0))[0])
            self.ends.append([node for _, node in ends])
        return self.number[key]

    def _last(self, word: str) -> int:
        """The state that the word ends in."""
        state = self.start
        for ch in word:
            if state < 0:
                return state
            move = self.moves[state].get(ch)
            if move is None:
                reached = set()
                for node, made in self.sets[state]:
                    reached.add((node, made + 1))  # a letter too many
                    for letter, child in self.next[node].items():
                        reached.add((child, made + (letter != ch)))
                if len(self.sets) > 50_000:  # forget what odd words have led to
                    self.__init_states()
                    return self._last(word)
                move = self.moves[state][ch] = self._state(reached)
            state = move
        return state

    def edits(self, word: str) -> int:
        """Edits to the nearest term, -1 if none is near enough."""
        state = self._last(word)
        return self.best[state] if state >= 0 else 0 if state == STEM else -1

    def terms_near(self, word: str) -> list[str]:
        """All terms near enough, but for stems."""
        state = self._last(word)
        return [self.name[node] for node in self.ends[state]] if state >= 0 else []

    def __init_states(self):
        self.sets, self.number, self.moves, self.best, self.ends = [], {}, [], [], []
        self.start = self._state({(0, 0)})


def _mark(text: str, places) -> int:
    """The first of ``places`` that holds a quotation mark, -1 if none does; an apostrophe inside a word is none."""
    for i in places:
        if text[i] in MARKS and not (0 < i < len(text) - 1 and text[i - 1].isalnum() and text[i + 1].isalnum()):
            return i
    return -1


def quoted(text: str, start: int, end: int) -> bool:
    """Whether a pair of quotation marks stands around the hit in its window, or a word of reporting before it there.

    The nearest marks on both sides decide: the left one must open (no letter or closing punctuation before it, text
    after it) and the right one close it, so a hit between two quotations is not quoted.
    """
    left = _mark(text, range(start - 1, max(-1, start - 1 - WINDOW), -1))
    right = _mark(text, range(end, min(len(text), end + WINDOW)))
    if left >= 0 and right >= 0 and text[right] in PAIRS.get(text[left], "") and not text[left + 1].isspace():
        if left == 0 or text[left - 1].isspace() or text[left - 1] in "([{:-–—" or text[left - 1] in MARKS:
            return True
    return any(w in REPORTING for w in WORD.findall(text[max(0, start - WINDOW) : start]))


class Scorer:
    def __init__(self, terms, ordinary=(), most: int = 200_000):
        self.lexicon, self.ordinary, self.most = Lexicon(terms), frozenset(ordinary), most
        self.seen: dict[str, int] = {}

    def edits(self, word: str) -> int:
        """Edits to the nearest term; -1 if none is near, or the word is an ordinary one."""
        if len(word) < SHORTEST or word in self.ordinary:
            return -1
        return self.lexicon.edits(word)

    def near(self, lowered: str) -> dict[str, int]:
        """The words of a text that are terms or near one, with their edits."""
        out, seen = {}, self.seen
        if len(seen) > self.most:
            seen = self.seen = {}
        for word in set(WORD.findall(lowered)):
            edits = seen.get(word)
            if edits is None:
                edits = seen[word] = self.edits(word)
            if edits >= 0:
                out[word] = edits
        return out

    def features(self, text: str) -> tuple[float, ...]:
        """log(1 + n) of all hits, of those not quoted, of the exact ones among these, and of fifty times the share of those not quoted."""
        lowered = text.lower()
        near = self.near(lowered)
        if not near:
            return (0.0,) * FEATURES
        words = hits = abuse = exact = 0
        for found in WORD.finditer(lowered):
            words += 1
            edits = near.get(found[0])
            if edits is not None:
                hits += 1
                if not quoted(lowered, *found.span()):
                    abuse += 1
                    exact += edits == 0
        return tuple(np.log1p([hits, abuse, exact, 50 * abuse / words]))


def _forms(word: str) -> list[str]:
    """The word and the stems that it begins with."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def _settings(batches):
    """Words and stems of each text, with the hashes of the words before and after each place."""
    for batch in batches:
        out = set()
        for text in batch["text"].to_pylist():
            every = ["", *WORD.findall(text.lower()), ""]
            hashes = [zlib.crc32(w.encode()) for w in every]
            out.update((w, hashes[i - 1], hashes[i + 1]) for i, w in enumerate(every) if len(w) >= SHORTEST)
        rows = [(form, before, after, word) for word, before, after in out for form in _forms(word)]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["form", "before", "after", "word"])


def _sign(batches):
    """Near copies mostly share the least two hashes of three words in a row."""
    for batch in batches:
        signs = []
        for text in batch["text"].to_pylist():
            every = WORD.findall(text.lower())
            threes = {zlib.crc32(" ".join(every[i : i + 3]).encode()) for i in range(max(1, len(every) - 2))}
            signs.append(",".join(map(str, sorted(threes)[:2])))
        yield pa.RecordBatch.from_arrays([batch["text"], batch["y"], batch["half"], pa.array(signs, pa.string())], ["text", "y", "half", "sign"])


def once(rows: DataFrame) -> DataFrame:
    """One of the near copies among labelled rows, which all go to the half of one of them."""
    signed = rows.select("text", "y", "half").mapInArrow(lean(_sign), "text string, y int, half int, sign string")
    kept = signed.groupBy("sign", "y").agg(F.min(F.struct(F.octet_length("text"), "text")).alias("kept"))
    return kept.select("kept.text", "y", F.pmod(F.xxhash64("sign"), F.lit(2)).cast("int").alias("half"))


def learn_terms(rows: DataFrame, least_places: float = 0.02, least_odds: float = 3.0, sides: int = 3, continued: int = 4) -> list[str]:
    """Words whose log odds in toxic texts, among all words there, reach ``least_odds`` against the other texts.

    What is counted in toxic texts are settings, so that the words of one copied text do not pass for terms, and both
    halves of the settings must show the word: the odds of one half propose it and those of the other prove it. A term
    needs ``least_places`` settings for each toxic row and ``sides`` different words on either side (the first or last word
    of a copied passage has one); a stem besides ``continued`` words that begin with it, and then stands for them. The number
    of terms has no cap; the share bounds it.
    """
    toxic, clean = rows.where("y = 1").select("text"), rows.where("y = 0").select("text")
    needed = max(1.5, least_places * toxic.count() / 2)
    stem = F.col("form").endswith("*")
    half = F.pmod(F.xxhash64("before", "after"), F.lit(2))
    places = toxic.mapInArrow(lean(_settings), "form string, before long, after long, word string").groupBy("form", "before", "after")
    places = places.agg(F.min("word").alias("least"), F.max("word").alias("most")).withColumn("half", half)
    counts = places.groupBy("form").agg(
        *(F.count_if(F.col("half") == k).alias(f"a{k}") for k in (0, 1)),
        *(F.size(F.collect_set(side)).alias(f"{side}s") for side in ("before", "after")),
        F.size(F.array_union(F.collect_set(F.when(stem, F.col("least"))), F.collect_set(F.when(stem, F.col("most"))))).alias("words"))
    shown = counts.where((F.col("a0") >= needed) & (F.col("a1") >= needed) & (F.col("befores") >= sides) & (F.col("afters") >= sides))
    shown = shown.where(~stem | (F.col("words") >= continued))
    found = {r["form"]: (r["a0"], r["a1"]) for r in shown.collect()}

    def count(batches):
        for batch in batches:
            words = Counter(w for text in batch["text"].to_pylist() for w in WORD.findall(text.lower()))
            forms = Counter({"": sum(words.values())})
            for word, n in words.items():
                for form in _forms(word):
                    if form in found:
                        forms[form] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(forms), pa.string()), pa.array(list(forms.values()), pa.int64())], ["form", "n"])

    def totals(texts):
        return {r["form"]: r["n"] for r in texts.mapInArrow(lean(count), "form string, n long").groupBy("form").agg(F.sum("n").alias("n")).collect()}

    others, length = totals(clean), totals(toxic).get("", 0)

    def odds(form):
        b = np.log((others.get(form, 0) / 2 + 0.5) / (others.get("", 0) / 2 + 1))
        return min(np.log((a + 0.5) / (length / 2 + 1)) - b for a in found[form])

    terms = sorted(f for f in found if odds(f) >= least_odds)
    places = {f[:-1]: sum(found[f]) for f in terms if f[-1] == "*"}
    stems = {s for s, n in places.items() if not any(len(g) > len(s) and g.startswith(s) and m >= 0.9 * n for g, m in places.items())}
    terms = [f for f in terms if f[-1] != "*" or f[:-1] in stems]
    return [f for f in terms if not any(f[:n] in stems for n in STEMS if n < len(f.rstrip("*")))]


def settle(rows: DataFrame, terms: list[str], least_odds: float = 1.0) -> tuple[list[str], list[str]]:
    """(terms, ordinary words), by the words near a term that the labelled texts use.

    A term whose near words together have log odds for toxic texts below ``least_odds`` gets ``=``, and no edits; of the
    near words of the other terms, those with such odds are ordinary.
    """
    def find(batches):
        scorer = Scorer(terms)
        for batch in batches:
            found = [(t, w, y) for text, y in zip(batch["text"].to_pylist(), batch["y"].to_pylist())
                     for w, edits in scorer.near(text.lower()).items() if edits > 0 for t in scorer.lexicon.terms_near(w)]
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32())], ["term", "word", "y"])

    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    near = rows.select("text", "y").mapInArrow(lean(find), "term string, word string, y int")

    def innocent(found, key):
        odds = F.log((F.col("a") + 0.5) / (total.get(1, 0) + 1)) - F.log((F.col("b") + 0.5) / (total.get(0, 0) + 1))
        counts = found.groupBy(key).agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
        return {r[0] for r in counts.where((F.col("b") > 0) & (odds < least_odds)).select(key).collect()}

    rigid = innocent(near, "term")
    words = innocent(near.where(~F.col("term").isin(sorted(rigid))) if rigid else near, "word")
    return [t + "=" if t in rigid else t for t in terms], sorted(words)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", allowed=None, most: int = MOST_LABELLED):
    """(terms, ordinary words, weights): weights for the terms of one half of the labelled sample, fitted on the other half,
    and the terms and ordinary words of both."""
    rows = materialise(once(training_rows(docs, labels, label, F.lit(True) if allowed is None else allowed, most)), "labelled")
    learned = rows.where("half = 0")
    terms, ordinary = settle(learned, learn_terms(learned))

    def measure(batches):
        scorer = Scorer(terms, ordinary)
        for batch in batches:
            x = np.array([scorer.features(t) for t in batch["text"].to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(FEATURES)), batch["y"]], [*"abcd", "y"])

    seen = rows.where("half = 1").select("text", "y").mapInArrow(lean(measure), "a double, b double, c double, d double, y int").toArrow()
    x = np.column_stack([seen[c].to_numpy() for c in "abcd"]).reshape(-1, FEATURES)
    weights = rising(x, seen["y"].to_numpy(), ridge=0.05)
    return *settle(rows, learn_terms(rows)), weights


def score(docs: DataFrame, model, name: str = "toxicity") -> DataFrame:
    """The columns of ``docs`` with the score (0 to 1) as ``name``, which replaces a column so named; NULL is an empty text."""
    terms, ordinary, weights = model

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(terms, ordinary)
        for texts in batches:
            x = np.array([scorer.features(t or "") for t in texts]).reshape(-1, FEATURES)
            yield pd.Series(probability(weights, x))
        del scorer
        give_back()

    return docs.withColumn(name, toxicity("text"))


def classify(docs: DataFrame, labels: DataFrame, parts: int = 5, kept_out: int = 0, most: int = MOST_LABELLED) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted. Labels are learned only from the folds not kept out.

    Empty texts have no hits; a NULL doc_id is never held out nor learned from; equal texts get equal scores; other
    columns are not read. Without labels of both kinds every text gets the smoothed rate of the label.
    """
    model = fit(docs, labels, allowed=fold(parts) != kept_out, most=most)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold(parts) == kept_out, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


def acceptable(docs: DataFrame, labels: DataFrame, below: float = 0.5, most: int = MOST_LABELLED) -> DataFrame:
    """The rows of ``docs`` that score below ``below``, by what all labels teach."""
    name = free(docs, "score")
    return score(docs, fit(docs, labels, most=most), name).where(F.col(name) < below).select(*own(docs))
