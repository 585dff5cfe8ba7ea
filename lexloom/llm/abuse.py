"""Abusive, hateful and sexual content: fuzzy lexicon look-up and learnt context-window scores.

A term is found however it is spelt: a token becomes a sequence of sets of letters (a star is any letter, 0 is o, @ is a,
letters of another alphabet are what they look like), and a Levenshtein automaton over it is walked together with the
trie of the lexicon. The lexicon knows general classes of words (see lexicon.py); what a hit means is weighed by the
classes that stand in a window around it. The weights start from stated ones (PRIOR in lexicon.py) and are moved by a
logistic fit to a bounded sample of reviewers' verdicts; no sentence has a rule of its own.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from . import lexicon as words_of_classes

#: Tokens on either side of a hit that bear on it; tokens that a quotation which merely names a word may have.
WINDOW, NAMED = 8, 3
#: Documents with a clear verdict that the weights are fitted to: those of the smallest hashes. Sentences with hits taken of
#: each of them. Both bound the sample, not what is scored.
LABELLED, SENTENCES = 5000, 64
#: Share of verdicts taken to be wrong; how strongly a weight is held to its prior, a
#: stated and an unstated one; rounds of choosing sentences, steps in each.
WRONG, HOLD, HOLD_REST, ROUNDS, STEPS = 0.04, 2.0, 8.0, 4, 60
#: Rows of the given term list that a worker holds; a longer list is an error.
LEXICON_LIMIT = 200_000
#: How much a hit counts that was found by a misspelling, of a long word and of a short one.
FUZZY, SHORT = 0.9, 0.5

# Letters that other signs stand for.
LEET = {"0": "оo", "3": "зеэe", "@": "аa", "1": "il1", "4": "чa", "6": "бb", "$": "s", "5": "s", "7": "т", "9": "д"}
AS_RUSSIAN = {"a": "а", "b": "вьб", "c": "с", "e": "е", "h": "н", "k": "к", "m": "м", "n": "пн", "o": "о", "p": "р", "r": "гя", "t": "т", "u": "и", "x": "х", "y": "у", "i": "и", "g": "д", "d": "д", "v": "в"}
AS_LATIN = {"а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "к": "k", "м": "m", "о": "o", "р": "p", "т": "t", "х": "x", "у": "y", "ѕ": "s", "і": "i", "ј": "j", "п": "n", "и": "u"}

_TOKEN = re.compile(r"[\w@$*]+")
_SPACED = re.compile(r"(?<![\w.*@$])(?:[\w@$*][ .\-_]){2,}[\w@$*](?![\w*@$])")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff\u0301\u202a-\u202e]")
_END = re.compile(r"[.!?…。！？।]+|\n[ \t]*\n|\n(?=[#>])")
_QUOTED = re.compile("«[^«»]*»|“[^“”]*”|„[^„“”]*[“”]|\"[^\"]*\"|‘[^‘’]*’|(?<!\\w)'[^']*'(?!\\w)")
_SECOND = re.compile(r"\w{2,}[её]шь$|\w{3,}ишь$")

#: A hit: class -> how much it counts (0..1).
Hits = dict[str, float]
#: A sentence: its tokens, each with its hits.
Sentence = list[tuple[str, Hits]]


class Lexicon:
    """The words of all classes as a trie; finds the classes of a token."""

    def __init__(self, extra: Iterable[tuple[str, str]] = ()):
        """extra: further (term, class); their inflected forms are found too."""
        self.words: dict[str, set[str]] = defaultdict(set)
        for form, own in words_of_classes.forms(extra):
            self.words[form.replace("ё", "е")].add(own)
        self.words = dict(self.words)
        self.trie: dict = {}
        self.heads: set[str] = set()
        self.tails: set[str] = set()
        for w, classes in self.words.items():
            open_ = frozenset(classes - words_of_classes.EXACT)
            if not open_ or len(w) < 4:
                continue
            node = self.trie
            for c in w:
                node = node.setdefault(c, {})
            node[""] = (w, open_)
            self.heads |= {w[:k] for k in range(2, len(w) + 1)}
            self.tails |= {w[-k:] for k in range(2, len(w))}
        self.cache: dict[str, Hits] = {}

    def classes(self, token: str) -> Hits:
        got = self.cache.get(token)
        if got is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            got = self.cache[token] = self._classes(token)
        return got

    def _classes(self, token: str) -> Hits:
        token = token.replace("ё", "е")
        if token in self.words:
            return dict.fromkeys(self.words[token], 1.0)
        if not any(c.isalpha() for c in token):
            return {}
        odd = any(not c.isalpha() for c in token)
        russian = any("а" <= c <= "я" for c in token)
        mixed = russian and any("a" <= c <= "z" for c in token)
        squeezed = re.sub(r"(.)\1{2,}", r"\1", token)
        stretched = squeezed != token
        found: Hits = {}
        if odd or mixed or stretched or len(token) >= 4:
            ordinary = token.startswith(words_of_classes.ORDINARY)
            for form in {token, squeezed, re.sub(r"\*+", "*", token)}:
                for alphabet in ("r", "l") if mixed or odd else ("r",) if russian else ("l",):
                    # Signs inside a token are explained first; a plainly written one may be one letter off.
                    room = 0 if odd or mixed or stretched else 1
                    if room and (ordinary or not self._may(form)):
                        continue
                    for own, much in self._walk([_letters(c, alphabet) for c in form], room).items():
                        found[own] = max(much, found.get(own, 0.0))
            if stretched and not found:
                found = dict.fromkeys(self.words.get(re.sub(r"(.)\1+", r"\1", token), ()), 1.0)
        if russian and not found and _SECOND.match(token):
            found["you"] = 0.6  # a verb of the second person
        return found

    def _may(self, token: str) -> bool:
        """Whether a word of the trie can be within one edit: then one half of the token is as written in the word."""
        k = len(token) // 2
        return token[:k] in self.heads or token[k:] in self.tails

    def _walk(self, sets: list[str], room: int) -> Hits:
        """The classes of the trie's words within `room` edits of the token, and how much the best of them counts.

        A state of the Levenshtein automaton is the positions in the token that can be reached with their least
        number of edits; it goes down the trie letter by letter and stops where no position is left."""
        n, out = len(sets), {}

        def skip(state: dict[int, int]) -> dict[int, int]:
            for i in sorted(state):  # letters of the token too many
                while state[i] < room and i < n and state.get(i + 1, room + 1) > state[i] + 1:
                    state[i + 1] = state[i] + 1
                    i += 1
            return state

        def down(node: dict, state: dict[int, int], depth: int) -> None:
            end = node.get("")
            if end is not None and n in state:
                for own in end[1]:
                    much = 1.0 if state[n] == 0 else _misspelt(own, len(end[0]))
                    if much:
                        out[own] = max(much, out.get(own, 0.0))
            for c, child in node.items():
                if c == "":
                    continue
                new: dict[int, int] = {}
                for i, e in state.items():
                    if i < n:
                        cost = e if c in sets[i] or sets[i] == "*" else e + 1
                        if cost <= room and cost < new.get(i + 1, room + 1):
                            new[i + 1] = cost
                    if e < room and e + 1 < new.get(i, room + 1):
                        new[i] = e + 1
                # A word keeps its first letter.
                if new and (depth or room == 0 or new.get(1) == 0):
                    down(child, skip(new) if room else new, depth + 1)

        down(self.trie, skip({0: 0}) if room else {0: 0}, 0)
        return out

    def inside(self, letters: str) -> list[str]:
        """A run of single letters may hold several words: cut greedily at the longest known ones."""
        out, i = [], 0
        while i < len(letters):
            for j in range(len(letters), i, -1):
                if j - i >= 3 and self.classes(letters[i:j]):
                    out.append(letters[i:j])
                    i = j
                    break
            else:
                i += 1
        return out or [letters]


def _misspelt(own: str, letters: int) -> float:
    """How much a hit of a class counts that is one letter off a word of so many letters."""
    if letters >= words_of_classes.MISSPELT.get(own, 99):
        return FUZZY
    return SHORT if letters >= words_of_classes.MISSPELT_SHORT.get(own, 99) else 0.0


@lru_cache(maxsize=4096)
def _letters(c: str, alphabet: str) -> str:
    if c == "*":
        return "*"
    if c in LEET:
        return LEET[c]
    if alphabet == "r" and c in AS_RUSSIAN:
        return AS_RUSSIAN[c]
    if alphabet == "l" and c in AS_LATIN:
        return AS_LATIN[c]
    return c


def _sentences(text: str, lexicon: Lexicon) -> Iterator[Sentence]:
    """The sentences of a text that hold a hit of a class that can make one abusive."""
    text = _INVISIBLE.sub("", text).lower()

    def joined(m: re.Match) -> str:
        run = re.sub(r"[ .\-_]", "", m.group())
        return " " + " ".join(lexicon.inside(run)) + " " if len(run) > 2 else m.group()

    text = _SPACED.sub(joined, text)
    for part in _END.split(text):
        tokens, places, core = [], [], False
        for m in _TOKEN.finditer(part):
            t = m.group().strip("_")
            bare = t.strip("*")
            if not bare:
                continue
            hits = lexicon.classes(t) if "*" in t[1:-1] or t == bare else lexicon.classes(bare) or lexicon.classes(t)
            if not hits and "**" in t:
                own = [(p, lexicon.classes(p)) for p in t.split("**") if p]
            else:
                own = [(bare, hits)]
            for one in own:
                tokens.append(one)
                places.append(m.start())
                core = core or not words_of_classes.CORE.isdisjoint(one[1])
        if core:
            yield _named(_phrases(tokens), part, places)


def _phrases(tokens: Sentence) -> Sentence:
    """Words that mean something else together than alone."""
    for k in range(len(tokens) - 1):
        own = words_of_classes.PHRASES.get((tokens[k][0].replace("ё", "е"), tokens[k + 1][0].replace("ё", "е")))
        if own:
            tokens[k] = (tokens[k][0], tokens[k][1] | {own: 1.0})
    return tokens


def _named(tokens: Sentence, part: str, places: list[int]) -> Sentence:
    """Takes back the hits in words that are merely named: alone or nearly so in quotation marks with a word like "word"
    or "term" nearby, or right behind such a word. Other quotations are somebody's speech and count."""
    naming = [k for k, (_, hits) in enumerate(tokens) if "mention" in hits]
    if not naming:
        return tokens
    named = {k + d for k in naming for d in (1, 2)}
    for m in _QUOTED.finditer(part):
        inside = [k for k, at in enumerate(places) if m.start() <= at < m.end()]
        if inside and len(inside) <= NAMED and any(-WINDOW <= k - inside[0] <= WINDOW for k in naming):
            named.update(inside)
    return [(t, hits if k not in named or "mention" in hits else {}) for k, (t, hits) in enumerate(tokens)]


def sentence_features(tokens: Sentence) -> dict[str, dict[str, float]]:
    """category -> {feature: value}: what of a sentence bears on it.

    A class that is there counts as its surest hit; two classes within WINDOW tokens of each other as the product of
    theirs (a~b); a class right behind somebody addressed (you>a, with a verb like "are" or few words between) or
    right beside (you|a) apart from that, likewise of somebody spoken of and of a group of people; and the number of different words of the sexual classes."""
    at: dict[str, list[tuple[int, float]]] = defaultdict(list)
    for i, (_, hits) in enumerate(tokens):
        for own, much in hits.items():
            at[own].append((i, much))
    single = {own: max(x for _, x in hits) for own, hits in at.items()}
    pairs: dict[str, float] = {}
    owns = sorted(at)
    for n, a in enumerate(owns):
        for b in owns[n:]:
            if a not in words_of_classes.CORE and b not in words_of_classes.CORE:
                continue
            best = max((x * y for i, x in at[a] for j, y in at[b] if i != j and abs(i - j) <= WINDOW and (a != b or tokens[i][0] != tokens[j][0])), default=0.0)
            if best:
                pairs[f"{a}~{b}"] = best
    for who in ("you", "third", "ident"):
        for own in words_of_classes.SAID if who in at else ():
            for i, x in at[who]:
                for j, y in at.get(own, ()):
                    said = 0 < j - i <= 3 or 0 < j - i <= 6 and any("be" in tokens[k][1] for k in range(i + 1, min(i + 3, j)))
                    if said:
                        pairs[f"{who}>{own}"] = max(x * y, pairs.get(f"{who}>{own}", 0.0))
                    if abs(i - j) == 1 and who != "third":
                        pairs[f"{who}|{own}"] = max(x * y, pairs.get(f"{who}|{own}", 0.0))
    out: dict[str, dict[str, float]] = {}
    for category, classes in words_of_classes.CATEGORIES.items():
        if classes.isdisjoint(at):
            continue
        own = {c: single[c] for c in classes if c in at}
        own |= {p: v for p, v in pairs.items() if not classes.isdisjoint(re.split("[~>|]", p))}
        if category == "sexual":
            some = len({tokens[i][0] for c in classes for i, _ in at.get(c, ())})
            own |= {f"words{k}": 1.0 for k in (2, 3) if some >= k}
        out[category] = own
    return out


def weight_of(feature: str, weights: dict[str, float]) -> float:
    return weights.get(feature, words_of_classes.PRIOR.get(feature, 0.0))


def sentence_scores(tokens: Sentence, weights: dict[str, float]) -> dict[str, float]:
    """The probability of each category for one sentence."""
    out = {}
    for category, own in sentence_features(tokens).items():
        z = weight_of("bias", weights) + sum(v * weight_of(f, weights) for f, v in own.items())
        out[category] = float(1 / (1 + np.exp(-z)))
    return out


def document_scores(text: str | None, lexicon: Lexicon, weights: dict[str, float]) -> tuple[float, float, float, int]:
    """The highest probability of each category over the sentences, and the number of sentences that reach 0.5."""
    best = dict.fromkeys(words_of_classes.CATEGORIES, 0.0)
    count = 0
    for tokens in _sentences(text or "", lexicon):
        got = sentence_scores(tokens, weights)
        for k, v in got.items():
            best[k] = max(best[k], v)
        count += any(v >= 0.5 for v in got.values())
    return best["abuse"], best["hate"], best["sexual"], count


def fitted(rows: pd.DataFrame) -> dict[str, float]:
    """The weights that the sample moves away from their priors.

    rows: doc_id, toxic (0 or 1), feature, value, sentence (its number in the document and category). A document is as
    bad as its worst sentence: in each of ROUNDS the worst one under the present weights stands for it, then all
    weights make STEPS of gradient descent on the likelihood of verdicts that are wrong at a rate of WRONG, with a penalty
    of HOLD (HOLD_REST where none is stated) per squared distance from the prior. Same rows in any order, same weights."""
    if rows.empty:
        return {}
    rows = rows.sort_values(["doc_id", "sentence", "feature"]).reset_index(drop=True)
    names = sorted({*rows.feature, "bias"})
    place = {f: k for k, f in enumerate(names)}
    prior = np.array([words_of_classes.PRIOR.get(f, 0.0) for f in names])
    key = rows[["doc_id", "sentence"]].drop_duplicates().reset_index(drop=True)
    number = pd.MultiIndex.from_frame(key)
    x = np.zeros((len(key), len(names)))
    np.add.at(x, (number.get_indexer(pd.MultiIndex.from_frame(rows[["doc_id", "sentence"]])), rows.feature.map(place).to_numpy()), rows.value.to_numpy())
    x[:, place["bias"]] = 1.0
    verdict = rows.groupby("doc_id").toxic.first()
    docs, owner = np.unique(key.doc_id.to_numpy(), return_inverse=True)
    y = verdict.loc[docs].to_numpy()
    hold = np.array([HOLD if f in words_of_classes.PRIOR else HOLD_REST for f in names])
    w = prior.copy()
    for _ in range(ROUNDS):
        z = x @ w
        order = np.lexsort((np.arange(len(z)), -z, owner))
        first = order[np.unique(owner[order], return_index=True)[1]]
        own = x[first]
        # The step that no curvature of this loss can make diverge.
        rate = 1.0 / (HOLD_REST + 0.25 * np.linalg.norm(own, 2) ** 2)
        v, momentum = w.copy(), w.copy()
        for k in range(STEPS):
            p = 1 / (1 + np.exp(-own @ momentum))
            q = WRONG + (1 - 2 * WRONG) * p
            slope = (1 - 2 * WRONG) * p * (1 - p) * (q - y) / (q * (1 - q))
            new = momentum - rate * (own.T @ slope + hold * (momentum - prior))
            momentum = new + k / (k + 3) * (new - v)
            v = new
        w = v
    return {f: float(round(a, 6)) for f, a in zip(names, w)}


CLASS_OF = {"abuse": "insult", "hate": "dehuman", "sexual": "arouse"}


def learnt(documents: DataFrame, doc_id: str, text: str, labels: DataFrame, extra: list[tuple[str, str]]) -> dict[str, float]:
    """The weights fitted to reviewers' verdicts.

    labels: doc_id, toxic (0 or 1), repeated rows count once. Documents on which most verdicts agree are taken,
    LABELLED of them at most by the hash of their id, SENTENCES sentences of each at most; what comes to the driver is
    bounded by that. No labels: no weights, the priors hold."""
    clear = labels.select("doc_id", "rater", "toxic").distinct().where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.avg("toxic").alias("rate")).where("rate != 0.5")
    sample = clear.select("doc_id", (F.col("rate") > 0.5).cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Lexicon(extra)
        for part in parts:
            rows = []
            for i, t, toxic in zip(part.doc_id, part.text, part.toxic):
                taken = 0
                for tokens in _sentences(t, own):
                    for category, features in sentence_features(tokens).items():
                        rows += [(i, toxic, f"{taken:03d}{category}", f, v) for f, v in features.items()]
                    taken += 1
                    if taken == SENTENCES:
                        break
            yield pd.DataFrame(rows, columns=["doc_id", "toxic", "sentence", "feature", "value"])

    # LABELLED rows at most.
    held = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max_by("text", F.length("text")).alias("text"), F.first("toxic").alias("toxic"))
    return fitted(held.mapInPandas(run, f"doc_id {kind}, toxic int, sentence string, feature string, value double").toPandas())


def scored(documents: DataFrame, doc_id: str, text: str, terms: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, abuse, hate, sexual, score, sentences): each distinct id with its probabilities; score = the highest one,
    sentences = how many reach 0.5.

    terms: term, category; a word list that each worker holds (an error beyond LEXICON_LIMIT rows). Null terms and
    unknown categories are left out. labels: see learnt; without them the stated weights hold. Null and empty texts
    score 0; a null id stays null. Whole texts are read."""
    rows = terms.select("term", "category").where("term is not null").distinct().limit(LEXICON_LIMIT + 1).collect()
    if len(rows) > LEXICON_LIMIT:
        raise ValueError("the term list is too long to be held by each worker")
    extra = sorted((r.term, CLASS_OF[r.category]) for r in rows if r.category in CLASS_OF)
    weights = learnt(documents, doc_id, text, labels, extra) if labels is not None else {}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(extra)
        for part in parts:
            got = [document_scores(t, lexicon, weights) for t in part.text]
            out = pd.DataFrame(got, columns=["abuse", "hate", "sexual", "sentences"])
            out.insert(0, "doc_id", part.doc_id.to_numpy())
            out["score"] = out[["abuse", "hate", "sexual"]].max(axis=1)
            yield out

    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = spread(docs).mapInPandas(run, f"doc_id {kind}, abuse double, hate double, sexual double, score double, sentences int")
    return found.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in ("abuse", "hate", "sexual", "score", "sentences")])


def clean_name(c):
    """A source's name without case, blanks around it and a region suffix; null and '' are one: null."""
    k = F.regexp_replace(F.trim(F.lower(F.regexp_replace(c, "[\\s\\u00a0]+", " "))), "-xx$", "")
    return F.when(k != "", k)


def rates(documents: DataFrame, scores: DataFrame, doc_id: str, source: str, least: float = 0.5) -> DataFrame:
    """(source, documents, flagged, rate) by clean source; documents count once by id, null sources are one row."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), clean_name(F.col(source)).alias("source")).distinct()
    return (
        docs.join(scores.select("doc_id", "score"), "doc_id", "left")
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("score") >= least).alias("flagged"))
        .withColumn("rate", F.round(F.col("flagged") / F.col("documents"), 6))
    )
