"""Sentence alignment of two editions: by length first, then by word translations learnt from what that is sure of."""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .sentences import dealt, sentence_texts

#: Rounds of expectation-maximization; association below which a pair of words is not a translation (Dice); how sure a
#: length bead must be; how alike the anchors of two chapters are that share none of their own; least score of a pair.
ROUNDS, DICE, SURE, ALIKE, LEAST = 4, 0.03, 0.75, 0.5, 0.62
#: How much a relation that names two chapters counts, in anchors that only they share.
NAMED = 4.0

# Russian letters in Latin ones, as names are rendered.
TRANSLIT = str.maketrans(
    dict(zip("абвгдеёзийклмнопрстуфыэ", "abvgdeeziyklmnoprstufye", strict=True))
    | {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ь": "", "ю": "yu", "я": "ya"}
)
RELATIONS = ("translation", "translated", "ru-en", "en-ru", "перевод")

_WORD = re.compile(r"\d+(?:[.,:]\d+)*|[^\W\d_]+(?:[-'’][^\W\d_]+)*")


def features(text: str, russian: bool) -> list[str]:
    """What of a sentence can be compared: numbers (#), names in Latin letters (@), stems of other words.

    A capital inside a sentence makes a name; the first word may be one (?) or not, so it comes as both, one behind the
    other."""
    out = []
    for k, m in enumerate(_WORD.finditer(text)):
        w = m.group()
        if w[0].isdigit():
            out.append("#" + re.sub(r"\D", ".", w))
            continue
        before = text[: m.start()].rstrip()
        first = k == 0 or before[-1:] in "«“„\"'(—:.!?…"
        low = w.lower().replace("ё", "е")
        if w[0].isupper() and len(w) > 2:
            latin = low.translate(TRANSLIT) if russian else low
            out.append(("?" if first else "@") + latin[: max(4, len(latin) - 2)][:9])
        if first or not w[0].isupper():
            out.append(low[:5] if russian else low)
    return out


def _language(name: pd.Series, text: pd.Series) -> pd.Series:
    out = []
    for n, t in zip(name, text):
        n = (n or "").strip().lower()[:2]
        if n not in ("ru", "en"):
            t = t or ""
            c, l = (sum(map(len, re.findall(letters, t))) for letters in ("[а-яёА-ЯЁ]+", "[a-zA-Z]+"))
            n = n if n else "ru" if c > 2 * l else "en" if l > 2 * c else ""
        out.append(n)
    return pd.Series(out)


def _lists(sentences: pd.Series, lang: pd.Series) -> pd.Series:
    return pd.Series([[{"start": int(s["start"]), "size": len(s["text"]), "words": features(s["text"], g == "ru")} for s in own] for own, g in zip(sentences, lang)])


def chapters(books: DataFrame) -> DataFrame:
    """(book_id, file_id, edition, lang, sentences array<struct<start, size, words>>): Russian and English books with text."""
    language = F.pandas_udf(_language, "string")
    own = books.select("book_id", "file_id", "lang", "content", F.col("collection_url").alias("edition")).where("content is not null and book_id is not null and collection_url is not null")
    cut_up = sentence_texts(own.withColumn("lang", language("lang", "content")).where("lang in ('ru', 'en')"), "file_id", "content", "book_id", "edition", "lang")
    lists = F.pandas_udf(_lists, "array<struct<start:long,size:int,words:array<string>>>")
    return cut_up.select("book_id", F.col("record").alias("file_id"), "edition", "lang", lists("sentences", "lang").alias("sentences"))


def named_pairs(own: DataFrame, relation: DataFrame) -> DataFrame:
    """(ru, en, book_ru, book_en): chapters, with their editions, of which some relation says that one translates the other."""
    name = F.lower(F.trim("relation_name"))
    edges = relation.where(name.isin(*RELATIONS)).select(F.col("file_1").alias("x"), F.col("file_2").alias("y"))
    edges = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    ru = own.where("lang = 'ru'").select(F.col("file_id").alias("x"), F.col("edition").alias("ru"), F.col("book_id").alias("book_ru"))
    en = own.where("lang = 'en'").select(F.col("file_id").alias("y"), F.col("edition").alias("en"), F.col("book_id").alias("book_en"))
    return edges.join(ru, "x").join(en, "y").select("ru", "en", "book_ru", "book_en").distinct()


def _met(words: list[tuple[int, str, bool]], others: list[tuple[int, str, bool]], named: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """The chapters of two editions that are the same one, by (book, anchor, sure) of both and the pairs that a relation names.

    What is surely a name or a number counts against a pair also if the other edition never has it."""
    held: tuple[dict[str, list[int]], dict[str, list[int]]] = (defaultdict(list), defaultdict(list))
    books = [sorted({b for b, _, _ in own} | {pair[k] for pair in named}) for k, own in enumerate((words, others))]
    place = [{b: i for i, b in enumerate(own)} for own in books]
    for k, own in enumerate((words, others)):
        for b, w, _ in own:
            held[k][w].append(place[k][b])
    score = np.zeros((len(books[0]), len(books[1])))
    norms = [np.zeros(len(own)) for own in books]
    for w in sorted(held[0].keys() & held[1].keys()):
        r, e, weight = held[0][w], held[1][w], 2.0 if w.startswith("t:") else 1.0
        score[np.ix_(r, e)] += weight / (len(r) * len(e))
        norms[0][r] += weight / len(r) ** 2
        norms[1][e] += weight / len(e) ** 2
    for k, own in enumerate((words, others)):
        for b, w, sure in own:
            if sure and w not in held[1 - k]:
                norms[k][place[k][b]] += 1 / len(held[k][w]) ** 2
    alike = score / np.maximum(np.sqrt(np.outer(*norms)), 1e-12)
    for r, e in sorted(named):
        score[place[0][r], place[1][e]] += NAMED
    # Rounded, so that what is equal but for the order of its sum is equal.
    score, alike = score.round(9), alike.round(9)
    best = (score == score.max(axis=1, keepdims=True, initial=0)) & (score == score.max(axis=0, keepdims=True, initial=0))
    i, j = np.nonzero((best & (score >= 1)) | (alike >= ALIKE))
    at = [np.linspace(0, 1, len(own)) for own in books]
    out, taken = [], (set(), set())
    for k in np.lexsort((j, i, np.abs(at[0][i] - at[1][j]).round(9), -score[i, j])):
        if i[k] not in taken[0] and j[k] not in taken[1]:
            out.append((books[0][i[k]], books[1][j[k]]))
            taken[0].add(i[k])
            taken[1].add(j[k])
    return out


def _chapters_met(part: pd.DataFrame) -> pd.DataFrame:
    ru, en, named = (part[part.kind == k] for k in ("ru", "en", "named"))
    both = _met(*(list(zip(x.a.tolist(), x.anchor, x.b == 1)) for x in (ru, en)), {(int(a), int(b)) for a, b in zip(named.a, named.b)})
    return pd.DataFrame(both, columns=["book_ru", "book_en"])


def chapter_pairs(own: DataFrame, named: DataFrame, titles: DataFrame, words: DataFrame) -> DataFrame:
    """(book_ru, book_en): the chapters of two editions that are the same one.

    They share names and numbers, each counted by how few chapters of either edition have it, and words of their titles
    (looked up in `words`: r, e). A pair that a relation names (named_pairs) is taken to share NAMED such things to begin
    with. Chapters that are each other's best pair if they share as much as one thing that only they have; where all they share
    stands in many chapters, if their weighed sets are ALIKE (cosine, over what both editions hold and what is surely a name). The greatest scores pair first,
    of equal ones those whose places in their editions are nearest. titles: book_id, title.

    Two editions are one task: a matrix of their chapters."""
    pairs = named.select("ru", "en").distinct()
    told = F.expr("transform(filter(flatten(transform(sentences, s -> s.words)), w -> w like '@%' or w like '?%' or w like '#__%'), w -> if(w like '?%', named_struct('w', replace(w, '?', '@'), 'sure', 0L), named_struct('w', w, 'sure', 1L)))")
    anchors = own.select("book_id", "edition", "lang", F.explode(F.array_distinct(told)).alias("x")).select("book_id", "edition", "lang", F.col("x.w").alias("anchor"), "x.sure")
    title = F.pandas_udf(lambda t, g: pd.Series([features(re.sub(r"(?i)^\W*(глава|chapter)\W+[\w-]+\W+|\(.*\)|^[ivxlc\d]+\W+", " ", x or "").lower(), h == "ru") for x, h in zip(t, g)]), "array<string>")
    titled = own.select("book_id", "edition", "lang").join(titles, "book_id")
    heads = titled.select("book_id", "edition", "lang", F.explode(F.array_distinct(title("title", "lang"))).alias("w"))
    told_ru = heads.where("lang = 'ru'").join(words.toDF("w", "e"), "w").select("book_id", "edition", "lang", F.concat(F.lit("t:"), "e").alias("anchor"), F.lit(0).cast("long").alias("sure"))
    told_en = heads.where("lang = 'en'").select("book_id", "edition", "lang", F.concat(F.lit("t:"), "w").alias("anchor"), F.lit(0).cast("long").alias("sure"))
    every = anchors.unionByName(told_ru).unionByName(told_en).groupBy("book_id", "edition", "lang", "anchor").agg(F.max("sure").alias("sure"))
    none = F.lit(None)
    rows = named.select("ru", "en", F.lit("named").alias("kind"), F.col("book_ru").alias("a"), F.col("book_en").alias("b"), none.cast("string").alias("anchor")).distinct()
    for side in ("ru", "en"):
        held = every.where(F.col("lang") == side).select(F.col("edition").alias(side), F.col("book_id").alias("a"), "anchor", F.col("sure").alias("b"))
        rows = rows.unionByName(pairs.join(held, side).select("ru", "en", F.lit(side).alias("kind"), "a", "b", "anchor"))
    return rows.groupBy("ru", "en").applyInPandas(_chapters_met, "book_ru long, book_en long").distinct()


def length_beads(ru: list[int], en: list[int]) -> list[tuple[int, int, float]]:
    """The 1-1 pairs of the best alignment by length alone, each with how sure it is (0..1).

    Dynamic programming over beads 1-1, 1-0, 0-1, 1-2, 2-1 in a band around the diagonal."""
    n, m = len(ru), len(en)
    if not n or not m:
        return []
    ratio = sum(en) / max(1, sum(ru))
    # Costs (negative log probability) of the kinds of bead.
    prior = {(1, 1): 0.12, (1, 0): 4.0, (0, 1): 4.0, (1, 2): 2.4, (2, 1): 2.4}
    # The lengths of both sides drift apart like a random walk.
    band = max(12, abs(n - m) + 8, int(2 * math.sqrt(max(n, m))))

    def cost(a: int, b: int) -> float:
        d = (b - a * ratio) / math.sqrt(max(1.0, (a * ratio + b) / 2) * 4.5)
        return min(25.0, d * d / 2)

    best: dict[tuple[int, int], tuple[float, int, int]] = {(0, 0): (0.0, 0, 0)}
    for i in range(n + 1):
        mid = round(i * m / n)
        for j in range(max(0, mid - band), min(m, mid + band) + 1):
            if not i and not j:
                continue
            top = None
            for (a, b), p in prior.items():
                got = best.get((i - a, j - b))
                if got is None:
                    continue
                c = got[0] + p + (cost(sum(ru[i - a : i]), sum(en[j - b : j])) if a and b else 0)
                if top is None or c < top[0]:
                    top = (c, a, b)
            if top:
                best[i, j] = top
    i, j, out = n, m, []
    while (i or j) and (i, j) in best:
        _, a, b = best[i, j]
        if a == b == 1:
            out.append((i - 1, j - 1, math.exp(-cost(ru[i - 1], en[j - 1]))))
        i, j = i - a, j - b
    return out[::-1]


def _sure(part: pd.DataFrame) -> pd.DataFrame:
    """Of each chapter pair the sentence pairs that length alone is sure of, their names and numbers taken into account."""
    rows = []
    for pair, ru, en in zip(part.pair, part.ru, part.en):
        beads = length_beads([s["size"] for s in ru], [s["size"] for s in en])
        for k, (i, j, p) in enumerate(beads):
            a, b = list(ru[i]["words"]), list(en[j]["words"])
            told_a, told_b = {w[1:] for w in a if w[0] in "#@"}, {w[1:] for w in b if w[0] in "#@"}
            may_a, may_b = {w[1:] for w in a if w[0] in "#@?"}, {w[1:] for w in b if w[0] in "#@?"}
            # Sure: the lengths fit well, and what both would show untranslated doesn't contradict.
            if p >= SURE and (not told_a or not told_b or may_a & may_b):
                rows.append((f"{pair}:{k}", sorted({w for w in a if w[0] not in "#@?"}), sorted({w for w in b if w[0] not in "#@?"})))
    return pd.DataFrame(rows, columns=["pair", "r", "e"])


def translations(sure: DataFrame, glossary: DataFrame) -> DataFrame:
    """(r, e, p): word translations by expectation-maximization over sure sentence pairs; p = sqrt(t(e | r) t(r | e)).

    sure: pair, r array, e array. glossary: ru_word, en_word; its entries are sentence pairs too. Pairs of words that
    hardly ever meet (Dice under DICE) are dropped before the first round; counts cover all pairs of sentences. Words and
    pairs go by 64-bit hashes, as they are shuffled and sorted in every round, and become words again at the end."""
    words = F.pandas_udf(lambda t, g: pd.Series([sorted({w for w in features((x or "").lower(), h == "ru") if w[0] not in "#@?"}) for x, h in zip(t, g)]), "array<string>")
    clean = glossary.where("ru_word is not null and en_word is not null").select(F.lower("ru_word").alias("a"), F.lower("en_word").alias("b")).distinct()
    entries = clean.select(F.concat(F.lit("g:"), "a", F.lit(":"), "b").alias("pair"), words("a", F.lit("ru")).alias("r"), words("b", F.lit("en")).alias("e"))
    spelt = sure.unionByName(entries)
    hashed = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    every = spelt.select(F.xxhash64("pair").alias("pair"), hashed(F.col("r")).alias("r"), hashed(F.col("e")).alias("e"))
    r = every.select("pair", F.explode("r").alias("r"), "e")
    met = r.select("pair", "r", F.explode("e").alias("e"))
    both = met.groupBy("r", "e").agg(F.count(F.lit(1)).alias("n"))
    of_r = every.select(F.explode("r").alias("r")).groupBy("r").agg(F.count(F.lit(1)).alias("nr"))
    of_e = every.select(F.explode("e").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("ne"))
    dice = both.join(of_r, "r").join(of_e, "e").withColumn("d", 2 * F.col("n") / (F.col("nr") + F.col("ne")))
    t = dice.where(F.col("d") >= DICE).select("r", "e", F.col("d").alias("p"))
    links = cut(met.join(t.select("r", "e"), ["r", "e"]))
    for _ in range(ROUNDS):
        linked = links.join(t.select("r", "e", "p"), ["r", "e"])
        share = linked.withColumn("c", F.col("p") / F.sum("p").over(Window.partitionBy("pair", "e")))
        counts = share.groupBy("r", "e").agg(F.sum("c").alias("c"))
        forward = F.col("c") / F.sum("c").over(Window.partitionBy("r"))
        t = counts.withColumn("p", forward).select("r", "e", "p", "c")
    # How far r and e mean each other: one of several synonyms stays near, what merely stands nearby does not.
    mutual = F.sqrt(F.col("p") * F.col("c") / F.sum("c").over(Window.partitionBy("e")))
    good = t.withColumn("p", mutual).where("p >= 0.1").select("r", "e", "p")
    for side in ("r", "e"):
        words_of = spelt.select(F.explode(side).alias("word")).distinct().withColumn(side, F.xxhash64("word"))
        good = good.join(words_of, side).drop(side).withColumnRenamed("word", side)
    return good.select("r", "e", "p")


#: Weight of a name or number; other words weigh by their rarity.
_TOLD = 1.6


def _weighed(words: list[str], rarity: dict[str, float]) -> tuple[dict[str, float], dict[str, str]]:
    """Weight of each distinct word of a sentence; for a first word that may be a name, the name -> the word."""
    weights, twins = {}, {}
    for k, w in enumerate(words):
        if w[0] == "?":
            weights.setdefault("@" + w[1:], 0.0)
            twins["@" + w[1:]] = words[k + 1]
        else:
            weights[w] = _TOLD if w[0] in "#@" else rarity.get(w, 1.0)
    return weights, twins


def _covered(sentence: tuple[dict[str, float], dict[str, str]], hits: dict[str, float]) -> float:
    """The share of a sentence's weight that was hit. A first word counts as a name if it was hit as one, else as a word."""
    weights, twins = sentence
    whole = sum(weights.values())
    got = sum(weights[w] * q for w, q in hits.items())
    for name, word in twins.items():
        if name in hits and weights[name] == 0.0:
            whole += _TOLD - weights.get(word, 0.0)
            got += _TOLD - weights.get(word, 0.0) * hits.get(word, 0.0)
    return got / whole if whole > 0 else 0.0


def lexical_pairs(ru: list, en: list, meaning: dict[str, dict[str, float]], rarity: dict[str, float]) -> list[tuple[int, int, float]]:
    """(i, j, score): sentences that say the same or of which one contains the other.

    Score of a pair: the share of the weight of the words of one sentence that the other renders, the larger of both
    sides, a little of the smaller. Candidates share a name, a number or a translation; the best chain of them is found
    by dynamic programming (a Fenwick tree of best chains by English place), monotone but for merges; what the chain
    leaves unpaired may pair out of order if it is better than anything else for both."""
    r_words, e_words = [_weighed(s["words"], rarity) for s in ru], [_weighed(s["words"], rarity) for s in en]
    places: dict[str, list[int]] = defaultdict(list)
    for j, (weights, _) in enumerate(e_words):
        for w in weights:
            places[w].append(j)
    cells: list[tuple[int, int, float]] = []
    for i, (weights, _) in enumerate(r_words):
        hit_r: dict[int, dict[str, float]] = defaultdict(dict)
        hit_e: dict[int, dict[str, float]] = defaultdict(dict)
        for w in weights:
            for e, p in ({w: 1.0} if w[0] in "#@" else meaning.get(w, {})).items():
                q = min(1.0, p / 0.25)
                for j in places.get(e, ()):
                    hit_r[j][w] = max(q, hit_r[j].get(w, 0.0))
                    hit_e[j][e] = max(q, hit_e[j].get(e, 0.0))
        for j in hit_r:
            a, b = _covered(r_words[i], hit_r[j]), _covered(e_words[j], hit_e[j])
            score = 0.7 * max(a, b) + 0.3 * min(a, b) if min(a, b) > 0.5 else 0.85 * max(a, b) + 0.15 * min(a, b)
            if score >= LEAST * 0.8:
                cells.append((i, j, score))
    m = len(en)
    tree: list[tuple[float, int]] = [(0.0, -1)] * (m + 2)

    def best_before(j: int) -> tuple[float, int]:
        got, j = (0.0, -1), j + 1
        while j > 0:
            got = max(got, tree[j])
            j -= j & -j
        return got

    def put(j: int, value: tuple[float, int]) -> None:
        j += 1
        while j <= m + 1:
            tree[j] = max(tree[j], value)
            j += j & -j

    cells.sort()
    back, chain = [-1] * len(cells), []
    for k, (i, j, s) in enumerate(cells):
        value, prev = best_before(j)  # allows the same j again: a merge
        back[k] = prev
        put(j, (value + s - 0.3, k))
    k = best_before(m)[1] if cells else -1
    while k >= 0:
        chain.append(k)
        k = back[k]
    top_r: dict[int, float] = {}
    top_e: dict[int, float] = {}
    for i, j, s in cells:
        top_r[i] = max(s, top_r.get(i, 0))
        top_e[j] = max(s, top_e.get(j, 0))
    taken = {k for k in chain if cells[k][2] >= LEAST}
    used_r = {cells[k][0] for k in taken}
    used_e = {cells[k][1] for k in taken}
    for k in sorted(range(len(cells)), key=lambda k: -cells[k][2]):
        i, j, s = cells[k]
        if k in taken or s < LEAST:
            continue
        if i not in used_r and j not in used_e or (i not in used_r or j not in used_e) and s >= 0.9 * top_r[i] and s >= 0.6 * top_e[j] or s >= 0.97 * max(top_r[i], top_e[j]) and s > 0.8:
            taken.add(k)
            used_r.add(i)
            used_e.add(j)
    return [cells[k] for k in sorted(taken)]


def _realigned(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    meaning: dict[str, dict[str, float]] = {}
    rarity: dict[str, float] = {}
    ru = en = None
    for kind, word, weight, means, sentences in zip(part.kind, part.word, part.weight, part.means, part.sentences):
        if kind == "ru":
            ru = sentences
        elif kind == "en":
            en = sentences
        else:
            rarity[word] = weight
            if means is not None:
                meaning[word] = {m["e"]: m["p"] for m in means}
    if ru is None or en is None:
        return pd.DataFrame([], columns=["book_ru", "start_ru", "book_en", "start_en", "score"])
    rows = [(key[0], int(ru[i]["start"]), key[1], int(en[j]["start"]), s) for i, j, s in lexical_pairs(ru, en, meaning, rarity)]
    return pd.DataFrame(rows, columns=["book_ru", "start_ru", "book_en", "start_en", "score"])


def aligned(books: DataFrame, relation: DataFrame, chapter_info: DataFrame, glossary: DataFrame) -> DataFrame:
    """(book_ru, start_ru, book_en, start_en, score): the sentence pairs of all chapters that exist in both editions.

    books: book_id, file_id, lang, content, collection_url, name; relation: file_1, file_2, relation_name;
    chapter_info: book_id, name. Books fetched twice and repeated rows count once; books without text, edition or a
    counterpart have no pairs; null languages are told by the script. A pair of chapters is one group, as large as two
    chapters; its words bring their translations along by a join, so no dictionary is held whole anywhere."""
    own = cut(chapters(books))
    named = cut(named_pairs(own, relation))
    titles = (
        books.groupBy("book_id").agg(F.min("name").alias("name"))
        .join(chapter_info.where("name is not null").groupBy("book_id").agg(F.min("name").alias("title")), "book_id", "left")
        .select("book_id", F.coalesce("title", "name").alias("title"))
    )
    one = F.pandas_udf(lambda t, g: pd.Series([next((w for w in features((x or "").lower(), h == "ru") if w[0] not in "#@?"), None) for x, h in zip(t, g)]), "string")
    entries = glossary.where("ru_word is not null and en_word is not null").select(one(F.lower("ru_word"), F.lit("ru")).alias("r"), F.lower("en_word").alias("e")).distinct()
    matched = cut(chapter_pairs(own, named, titles, entries))
    ru = own.select(F.col("book_id").alias("book_ru"), F.col("sentences").alias("ru"))
    en = own.select(F.col("book_id").alias("book_en"), F.col("sentences").alias("en"))
    # Read by three that follow.
    both = cut(matched.join(ru, "book_ru").join(en, "book_en").withColumn("pair", F.concat_ws("-", "book_ru", "book_en")))
    sure = dealt(both.select("pair", "ru", "en"), "pair").mapInPandas(lambda parts: map(_sure, parts), "pair string, r array<string>, e array<string>")
    t = cut(translations(cut(sure), glossary))
    means = t.groupBy("r").agg(F.collect_list(F.struct("e", "p")).alias("means"))
    spoken = both.select("book_ru", "book_en", F.explode(F.array(F.struct(F.lit("r").alias("side"), F.col("ru").alias("s")), F.struct(F.lit("e").alias("side"), F.col("en").alias("s")))).alias("x"))
    vocabulary = (
        spoken.select("book_ru", "book_en", "x.side", F.explode(F.expr("array_distinct(filter(flatten(transform(x.s, s -> s.words)), w -> not (w like '@%' or w like '#%' or w like '?%')))")).alias("word"))
    )
    chapters_in_all = matched.count()
    held = vocabulary.groupBy("side", "word").agg(F.count(F.lit(1)).alias("n"))
    weight = 0.4 + F.greatest(F.lit(0.0), F.log(F.lit(float(chapters_in_all + 1)) / F.col("n")) / F.log(F.lit(float(chapters_in_all + 2))))
    known = held.join(means, F.col("word") == F.col("r"), "left").select("side", "word", weight.alias("weight"), F.when(F.col("side") == "r", F.col("means")).alias("means"))
    nothing = F.lit(None)
    kinds = own.schema["sentences"].dataType
    words = vocabulary.join(known, ["side", "word"]).select("book_ru", "book_en", F.lit("word").alias("kind"), "word", "weight", "means", nothing.cast(kinds).alias("sentences"))
    lists = both.select("book_ru", "book_en", F.explode(F.array(F.struct(F.lit("ru").alias("kind"), F.col("ru").alias("sentences")), F.struct(F.lit("en").alias("kind"), F.col("en").alias("sentences")))).alias("x"))
    lists = lists.select("book_ru", "book_en", "x.kind", nothing.cast("string").alias("word"), nothing.cast("double").alias("weight"), nothing.cast(known.schema["means"].dataType).alias("means"), "x.sentences")
    return (
        dealt(words.unionByName(lists), "book_ru", "book_en").groupBy("book_ru", "book_en").applyInPandas(_realigned, "book_ru long, start_ru long, book_en long, start_en long, score double")
    )


def ordered(pairs: DataFrame) -> DataFrame:
    """(book_id_1, start_1, book_id_2, start_2), the smaller book first."""
    less = F.col("book_ru") < F.col("book_en")
    return pairs.select(
        F.when(less, F.col("book_ru")).otherwise(F.col("book_en")).alias("book_id_1"),
        F.when(less, F.col("start_ru")).otherwise(F.col("start_en")).alias("start_1"),
        F.when(less, F.col("book_en")).otherwise(F.col("book_ru")).alias("book_id_2"),
        F.when(less, F.col("start_en")).otherwise(F.col("start_ru")).alias("start_2"),
    ).distinct()
