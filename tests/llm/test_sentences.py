"""Boundaries: the rules on short texts, and that chunks compose to the same as one run."""

import random

import pytest

from lexloom.llm import sentences
from lexloom.llm.transducer import STATES, run_chunk, sentence_starts


def cut(text):
    s = [*sentence_starts(text), len(text)]
    return [text[a:b].strip() for a, b in zip(s, s[1:])]


CASES = [
    ["Он ушёл в 1864 г. из дома на ул. Садовой, д. 5.", "Потом вернулся."],
    ["По словам проф. Иванова, всё готово (см. гл. 3, стр. 12).", "А. С. Пушкин жил здесь."],
    ["Купил бумагу, клей и т. д. и ушёл.", "Цена 40 тыс. руб.", "Дорого?!"],
    ["«Стой! Кто там?» — крикнул сторож.", "Никто не ответил."],
    ["— Уже поздно, — сказал Вевин, — пора домой."],
    ["— Это он! — сказала Анна.", "— Где? — спросил Пётр."],
    ["Журнал «Ура!» сообщил новость.", "Он… не поверил."],
    ["Prof. Smith paid $5.50, i.e. almost nothing.", "He left at 5 p.m.", "Then it rained."],
    ["“Stop! Who is there?” asked the man.", "Nobody answered."],
    ["'In spring he came. So it was,' said Ann.", "It ended."],
    ["He saw it (the door was open!) to everyone’s surprise.", "Yes."],
    ["„Halt! Wer ist da?“, fragte die Wirtin.", "Am 19. Mai 1875 kam Dr. Kern, z. B. mit dem Boot."],
    ["“等等！你去哪儿？”船长低声说。", "他走了27.9公里。", "她回答：“天黑了。明天再来。”", "船长……忘记了。"],
    ["「待て！誰だ？」と彼は尋ねた。", "船は出た。"],
    ["डॉ. वेलान चला गया।", "“रुको! कौन है?” लोहार चिल्लाया।", "क्या वह आया?"],
    ["กัปตันพบแผนที่", "เขาเดินช้า ๆ แล้วซ่อม 59 ชิ้นที่ตลาด", "ฝนตก"],
]


@pytest.mark.parametrize("want", CASES)
def test_rules(want):
    joiner = "" if any("。" in w for w in want) else "\n" if want[0].startswith("—") else " "
    assert cut(joiner.join(want)) == want


def test_lines():
    text = "Странный дом\n\nВечером старик купил уютный стол за тёмным плащом и увидел новый\nДом у реки. Утром пошёл дождь.\n\n1) Новый мост\n\n2. Старый мост\n\nВот и всё."
    assert [" ".join(x.split()) for x in cut(text)] == ["Странный дом", "Вечером старик купил уютный стол за тёмным плащом и увидел новый Дом у реки.", "Утром пошёл дождь.", "1) Новый мост", "2. Старый мост", "Вот и всё."]


def test_blank_and_empty():
    assert sentence_starts("") == [] and sentence_starts(" \n\t ") == [] and sentence_starts("  Да") == [2]


def test_chunks_compose():
    rng = random.Random(1)
    texts = [" ".join(w for c in rng.sample(CASES, 6) for w in c) + "\n\n" + "\n".join(w for c in rng.sample(CASES, 4) for w in c) for _ in range(20)]
    for t in texts:
        assert sentence_starts(t, rng.choice([64, 100, 333])) == sentence_starts(t)


def test_functions_are_total():
    ends, events = run_chunk("И. Но «Да! Нет.» — он. Ну.", 0, 26)
    assert len(ends) == STATES and all(0 <= e < STATES for e in ends) and all(m < 2**63 for _, m in events)


def test_operator(spark):
    long = " ".join(f"Вечером номер {i} пришёл домой." for i in range(5000))
    rows = [("a", "Да. Нет.", 1), ("a", "Да. Нет.", 2), ("b", None, 1), ("c", "", 1), ("d", "  \n", 1), ("e", long, 1), (None, "Да.", 1)]
    df = spark.createDataFrame(rows, "file_id string, content string, record int")
    got = {(r.record, r.start_at) for r in sentences.text_sentences(df, "file_id", "content").collect()}
    assert got == {("a", 0), ("a", 4)} | {("e", p) for p in sentence_starts(long)}
    assert sentences.text_sentences(df.limit(0), "file_id", "content").count() == 0


def test_long_texts_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(sentences, "SPREAD", 1)
    long = " ".join(f"Вечером «номер {i}. Или нет» пришёл домой." for i in range(1500))
    df = spark.createDataFrame([("e", long)], "f string, c string")
    assert {r.start_at for r in sentences.text_sentences(df, "f", "c").collect()} == set(sentence_starts(long))


def test_tokens(spark):
    words = []
    for k in range(1500):
        words += [("Он", 1), ("сказал" if k % 3 else None, 1), ("привет", 0), (".", 1)]
    rows = [("f", 10_000 + i, None, i // 400, t, w) for i, (w, t) in enumerate(words)]
    rows += rows[:50] + [("g", 99, 5, 0, 1, "Нет")]
    df = spark.createDataFrame(rows, "file_id string, word_id long, sentence_id long, paragraph_id long, word_tail int, word string")
    got = sorted(r.start_at for r in sentences.token_sentences(df).collect())
    assert got == [10_000 + 4 * k for k in range(1500)]
    assert sentences.token_sentences(df.where("file_id = 'g'")).count() == 0


LONG = (
    "В пятницу вечером старый смотритель маяка Ефим Петрович Загорский увидел за туманом корабль капитана Дорна, который вёз из Риги книги для школы Ольги Марковны, письма для Веры Ильиничны Соколовой "
    "и несколько ящиков чая из Мадраса, а команда пела песни Шуберта и смотрела на огни Пскова. Утром пошёл дождь. Потом в гавань пришли Анна и Пётр, и смотритель рассказал им про Дорна, Ригу и книги Ольги Марковны."
)


@pytest.mark.parametrize("width", [30, 40, 46, 55, 64, 70, 84, 90, 100, 120])
@pytest.mark.parametrize("full", [True, False])
def test_wrapped_anywhere(width, full):
    """The same sentences however wide the lines are, filled as far as they go or broken at the first blank beyond the width."""
    lines, line = [], ""
    for word in LONG.split():
        if line and (len(line) + 1 + len(word) > width if full else len(line) >= width):
            lines.append(line)
            line = word
        else:
            line = f"{line} {word}".strip()
    got = cut("\n".join([*lines, line]))
    assert [" ".join(x.split()) for x in got] == [" ".join(x.split()) for x in cut(LONG)]


def test_lines_that_are_not_wrapped():
    """Lines of their own stay sentences of their own."""
    rng = random.Random(5)
    lines = [" ".join(["Строка", *("слово" for _ in range(rng.randint(1, 40)))]) for _ in range(30)]
    assert len(cut("\n".join(lines))) == 30


def test_texts_of_one_record(spark):
    """Each of two texts of a record is cut at its own boundaries; copies count once."""
    d = spark.createDataFrame([("a", "One two three four. Five six."), ("a", "One two three four. Five six."), ("a", "One. Two three four five."), ("b", None), ("c", " ")], "file_id string, content string")
    got = sorted([s["text"] for s in r.sentences] for r in sentences.sentence_texts(d, "file_id", "content").collect())
    assert got == [["One two three four.", "Five six."], ["One.", "Two three four five."]]


def test_width_in_the_operator(spark):
    """The operator takes a text's width from its lines as sentence_starts does."""
    text = "\n".join(LONG[i : i + 60] for i in range(0, len(LONG), 60))
    wrapped = "Заглавие\n\n" + __import__("textwrap").fill(LONG * 40, 64)
    d = spark.createDataFrame([("a", text), ("b", wrapped), ("c", LONG)], "file_id string, content string")
    got = {}
    for r in sentences.text_sentences(d, "file_id", "content").collect():
        got.setdefault(r.record, []).append(r.start_at)
    assert {k: sorted(v) for k, v in got.items()} == {"a": sentence_starts(text), "b": sentence_starts(wrapped), "c": sentence_starts(LONG)}
