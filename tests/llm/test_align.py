import random

from lexloom.llm import align


def test_length_beads():
    beads = align.length_beads([50, 80, 30, 60], [52, 79, 33, 61])
    assert [(i, j) for i, j, _ in beads] == [(0, 0), (1, 1), (2, 2), (3, 3)]
    beads = align.length_beads([50, 80, 30, 60], [52, 31, 61])
    assert (0, 0) in [(i, j) for i, j, _ in beads] and len(beads) <= 3
    assert align.length_beads([], [3]) == []


def test_features():
    assert "@fendegin"[:8] in [f[:8] for f in align.features("Вчера Фендегина пришла", True)]
    assert align.features("Фендегина пришла", True)[0].startswith("?fendegi")
    assert "#40.1" in align.features("на высоте 40,1 м", True) and "#40.1" in align.features("a height of 40.1 m", False)


NOUNS = dict(zip("мост ключ дом лес колокол портрет барабан сундук город берег туман замок поезд остров журнал".split(), "bridge key house forest bell portrait drum trunk town shore fog castle train island magazine".split()))
VERBS = dict(zip("нашёл продал купил потерял увидел открыл забыл украл нарисовал описал".split(), "found sold bought lost saw opened forgot stole drew described".split()))
ADJ = dict(zip("старый новый тихий красный чёрный тёмный высокий узкий мокрый пыльный".split(), "old new quiet red black dark tall narrow wet dusty".split()))
NAMES = dict(zip("Вевин Гофен Мурпин Лисдор Келмур Танбир Зармин".split(), "Vevin Gofen Murpin Lisdor Kelmur Tanbir Zarmin".split()))
WHEN = dict(zip("Вчера Утром Ночью Осенью".split(), ["Yesterday", "In the morning", "At night", "In autumn"]))


def said(rng):
    """One thing said in both languages, each in one or two sentences' worth of words."""
    w, n, v, a, x = (rng.choice(list(d)) for d in (WHEN, NAMES, VERBS, ADJ, NOUNS))
    return f"{w} {n} {v} {a} {x}", f"{WHEN[w]} {NAMES[n]} {VERBS[v]} the {ADJ[a]} {NOUNS[x]}"


def chapter(rng):
    """Texts of both editions and the pairs of starts that say the same, with omissions, merges and swaps."""
    facts = [said(rng) for _ in range(14)]
    ru, en = [[k] for k in range(14)], [[k] for k in range(14)]
    for side in (ru, en):
        del side[rng.randrange(len(side))]
        k = rng.randrange(len(side) - 1)
        side[k : k + 2] = [side[k] + side[k + 1]]
    k = rng.randrange(len(en) - 1)
    en[k], en[k + 1] = en[k + 1], en[k]
    low = lambda t: t[0].lower() + t[1:]
    r = [" и ".join(facts[f][0] if i == 0 else low(facts[f][0]) for i, f in enumerate(s)) + "." for s in ru]
    e = [", and ".join(facts[f][1] if i == 0 else low(facts[f][1]) for i, f in enumerate(s)) + "." for s in en]
    start = lambda t: [sum(len(x) + 1 for x in t[:k]) for k in range(len(t))]
    a, b = start(r), start(e)
    return " ".join(r), " ".join(e), {(a[i], b[j]) for i in range(len(ru)) for j in range(len(en)) if set(ru[i]) & set(en[j])}


def test_pairs(spark):
    rng = random.Random(4)
    books, info, rel, want = [], [], [], set()
    for k in range(30):
        r, e, true = chapter(rng)
        books.append((2 * k + 1, f"r{k}", "ru", r + f" В {1800 + k} году было тихо.", f"/r{k // 3}", f"Глава {k}"))
        books.append((2 * k + 2, f"e{k}", "EN" if k % 2 else "en", e + f" In {1800 + k} it was quiet.", f"/e{k // 3}", f"Chapter {k}"))
        want |= {(2 * k + 1, a, 2 * k + 2, b) for a, b in true} | {(2 * k + 1, len(r) + 1, 2 * k + 2, len(e) + 1)}
        info.append((2 * k + 1, f"Глава {k}"))
    books += [books[0], (900, "zz", "ru", None, "/r0", None), (901, "yy", None, "Один текст.", None, None)]
    rel = [(f"e{k}", f"r{k}", " Translation ") for k in range(0, 30, 3)] + [("e1", "e1", "sequel"), (None, "e1", "translation")]
    b = spark.createDataFrame(books, "book_id long, file_id string, lang string, content string, collection_url string, name string")
    r = spark.createDataFrame(rel, "file_1 string, file_2 string, relation_name string")
    c = spark.createDataFrame([*info, info[0], (None, "x"), (3, None)], "book_id long, name string")
    g = spark.createDataFrame([(a, NOUNS[a].upper() if len(a) % 2 else NOUNS[a]) for a in list(NOUNS)[:6]] + [(None, "x"), ("ы", None)], "ru_word string, en_word string")
    got = {tuple(x) for x in align.ordered(align.aligned(b, r, c, g)).collect()}
    assert len(got & want) / len(want) > 0.9 and len(got & want) / len(got) > 0.9
    assert align.aligned(b.limit(0), r.limit(0), c.limit(0), g.limit(0)).count() == 0
