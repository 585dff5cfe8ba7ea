import pytest

from lexloom.llm import abuse, lexicon

LEX = abuse.Lexicon([("мразь", "insult"), ("секс", "arouse")])
BAD = [
    "Слушай, ты тупицццца, убирайся отсюда!", "Да ты у р о д, иди проспись!", "Ты к.р.е.т.и.н, закрой рот!", "Верунин, ты просто убл*док и идиот, тебя все презирают.", "Узнаю, где живёшь и 0т0рву голову, мразь.",
    "Попадись мне только и п3р3л0м@ю ноги.", "Я тебя найду и переломаю руки.", "Ну и uдu0т это сочинил, сдохни уже.", "Посмотри на себя, Вевин: от тебя даже собака сбежит, жалкий человечишка.",
    "Таким, как ты, лучше бы вовсе не рождаться, мир станет чище.", "Автора бы выбросить в овраг, позор рода.", "Все заречные — грязные крысы, гнать их надо.", "Хуторяне не люди вовсе, пусть сгинут.", "Болотники хуже скота, пора их вымести.",
    "Горняцкие только плодятся и воруют, нечего их жалеть.", "You are a pathetic halfwit and a basttttard.", "You mоrоn, shut your mouth!", "I will find you and br3@k your legs.", "What a loser to print this, just drop dead.",
    "All barge people are filthy parasites and deserve no mercy.", "Она стонала, пока он ласкал её голую грудь, и кончила.", "They stripped naked and had sex all night.", "They tore off their clothes and had**sex all night.", "Whoever wrote this should jump off a bridge, a disgrace of a man.",
]
FINE = [
    "Слово «идиот» встречается в старом словаре с пометой «бранное».", "The dictionary marks the word “asshole” as rude.", "Крысы и паразиты погубили урожай в посёлке.", "Rats and other vermin ruined the harvest.", "A naked statue stands by the fountain.",
    "The form asks for name, sex and year of birth.", "Врач назначил осмотр груди и снимок.", "Дефенбин сломал руку, падая с крыши, и ноги у него тоже болели.", "The dog was a real bitch of good pedigree, the breeder noted.", "Закон запрещает оскорблять болотников и разжигать вражду к ним.",
    "Чтобы убить время, Мурдор чинил часы.", "Лапин — почётный член общества часовщиков.", "Соседка держит скотину: двух коров и козу.", "The pig and the cock belong to the landlady.", "", "Он искал новый дом.",
]

# Sentences of other shapes than those of the tables; the second lists were written before the operator was first run on them.
BAD_2 = [
    "You are a complete waste of oxygen and everybody hates you.",
    "I'm going to kill you and your whole family.",
    "Go kill yourself, nobody will miss you.",
    "Immigrants are nothing but parasites and criminals.",
    "He is a worthless piece of garbage.",
    "You disgusting pig, I hope you choke.",
    "All women are stupid and should not be allowed to vote.",
    "They should all be shot like dogs.",
    "She spread her legs and he thrust his cock inside her.",
    "He licked her nipples until she had an orgasm.",
    "I will cut your throat while you sleep.",
    "Shut your filthy mouth, you ugly hag.",
    "These people are animals and must be exterminated.",
    "What kind of moron writes such trash?",
    "I hope you get cancer and die.",
    "Your mother is a whore.",
    "You're so dumb it hurts.",
    "Jews are vermin.",
    "Somebody should burn your house down with you in it.",
    "Gypsies steal and lie, drive them out.",
    "Ты просто ничтожество, и все это знают.",
    "Я убью тебя, если ещё раз увижу.",
    "Чтоб ты сдох, урод.",
    "Мигранты — это зараза, их надо гнать поганой метлой.",
    "Все бабы дуры.",
    "Он вошёл в неё, и она застонала от страсти.",
    "Твоя мать шлюха.",
    "Какой же ты тупой баран.",
    "Иди и повесься, никто плакать не будет.",
    "Этот автор — бездарный кретин.",
    "Тебя надо расстрелять, тварь.",
    "Я тебе все зубы выбью, сука.",
    "Цыгане — воры и паразиты.",
    "Она раздвинула ноги и он вошёл в неё.",
    "Заткнись, дебил, пока цел.",
    "Чтобы ты провалился, гад проклятый.",
    "Этих нелюдей надо жечь.",
    "Он целовал её соски и ласкал бёдра, пока она стонала.",
    "Мерзкая ты баба, ненавижу тебя.",
    "Пошёл вон, придурок!",
]
FINE_2 = [
    "The doctor examined the patient's breast and found nothing.",
    "The police said that the man threatened to kill his neighbour.",
    "He killed time playing chess with his brother.",
    "The cat caught two rats in the barn.",
    "She painted a naked woman on a large canvas.",
    "The word bitch originally means a female dog.",
    "I would kill for a cup of coffee.",
    "You should feed the dog before you leave.",
    "All animals need water and food.",
    "The stupid printer is broken again.",
    "Parents should talk with their children about sex education.",
    "The villain dies at the end of the film.",
    "My feet are killing me after the walk.",
    "The court sentenced the thief to two years.",
    "Women and men should earn the same money.",
    "You beat me at cards again.",
    "The pigs were driven to the market.",
    "Do not let them burn the bread.",
    "The idiom to be a guinea pig means to be a test subject.",
    "I will break the news to you tomorrow.",
    "Врач осмотрел горло и руки мальчика.",
    "Он сломал ногу, катаясь на лыжах.",
    "Паразитов у собак лечат таблетками.",
    "Слово «дура» считается грубым.",
    "Свиньи лежали в грязной луже.",
    "Ты умрёшь от смеха, когда услышишь эту историю.",
    "Закон запрещает убивать животных.",
    "Мы убили весь день на уборку.",
    "Художник написал обнажённую модель.",
    "Надо гнать коров на луг.",
    "Ты сильный и умный человек.",
    "Я отрежу тебе кусок пирога.",
    "Он не дурак выпить чаю.",
    "Старый осёл вёз мешки с мукой.",
    "Все люди смертны.",
    "В романе герой убивает дракона.",
    "Она родилась в деревне и никогда не видела моря.",
    "Крысы бегут с тонущего корабля.",
    "Урок анатомии: строение полового члена.",
    "Жаль, что ты не смог прийти.",
]
BAD_3 = [
    "Nobody likes you, you pathetic little worm.",
    "I will smash your teeth in if I see you again.",
    "You people are scum.",
    "Refugees are a plague and should be wiped out.",
    "He grabbed her bare breasts and she moaned as he entered her.",
    "The author of this trash deserves to be shot.",
    "Die in a fire, you bastard.",
    "Those lazy savages breed like rats.",
    "Your face makes me sick, you ugly cow.",
    "You deserve to be beaten.",
    "They fucked on the kitchen table.",
    "Blacks are inferior and lazy.",
    "Ты тупая скотина, ненавижу.",
    "Сдохните все, твари.",
    "Вы все продажные шлюхи.",
    "Я найду тебя и переломаю тебе все кости.",
    "Евреи — паразиты, пора от них избавиться.",
    "Он гладил её голую грудь и ласкал соски.",
    "Тупые хохлы ни на что не способны.",
    "Автору руки бы оторвать за такую мерзость.",
    "Ну ты и идиот!",
    "Они трахались всю ночь.",
    "Вас всех надо перестрелять.",
    "Кто это написал, полный дегенерат?",
]
FINE_3 = [
    "The book describes how rats spread the plague.",
    "You are a good dog, said the boy.",
    "She moaned about the weather all day.",
    "They stripped the paint off the door.",
    "The doctor said your teeth need care.",
    "I hate this rain.",
    "The director shot the film in three weeks.",
    "He was born in a poor village and died in Paris.",
    "The law protects refugees and immigrants.",
    "We should all eat less sugar.",
    "Stop the car and let them out.",
    "Kill the process before you restart the server.",
    'The term "moron" was once used by psychologists.',
    "My neighbour has a lazy cat.",
    "Собака лежала у двери и ждала хозяина.",
    "Мы с тобой были глупы и молоды.",
    "Он ударился головой и сломал зуб.",
    "Никто не знал, что делать дальше.",
    "В музее стоит голая мраморная богиня.",
    "Ты должен принять лекарство.",
    "Все дети любят сказки.",
    "Сержант приказал открыть огонь.",
    "Он бросил курить и больше не болел.",
    "Термин «паразит» пришёл из греческого языка.",
]


def top(text):
    return max(abuse.document_scores(text, LEX, {})[:3])


@pytest.mark.parametrize("text", BAD)
def test_bad(text):
    assert top("Утром пошёл дождь. " + text + " Потом стало тихо.") >= 0.5


@pytest.mark.parametrize("text", FINE)
def test_fine(text):
    assert top("Утром пошёл дождь. " + text + " Потом стало тихо.") < 0.5


def test_other_shapes():
    """Held-out sentences: at least nine in ten are told rightly."""
    bad, fine = BAD_2 + BAD_3, FINE_2 + FINE_3
    assert sum(top(x) >= 0.5 for x in bad) >= 0.9 * len(bad)
    assert sum(top(x) < 0.5 for x in fine) >= 0.95 * len(fine)


def test_named_words():
    """A word that is named doesn't count; the same word said to somebody does, in quotation marks or not."""
    assert top("The word “idiot” is rude.") < 0.5
    assert top("“You idiot, get lost,” he said.") >= 0.5
    assert top("You are an idiot, and the word “idiot” is too good for you.") >= 0.5


def test_automaton_against_edit_distance():
    """The walk finds exactly the words within one edit that keep their first letter, of the classes that may be misspelt; the
    filter before it loses none."""

    def near(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    for token in ("подонков", "придурак", "скатина", "мерзавец", "halfwitt", "bastrd", "совсем", "cretins", "идот", "оргазим"):
        want = {}
        for w, classes in LEX.words.items():
            if w[0] == token[0] and len(w) >= 4 and near(w, token) <= 1:
                for own in classes - lexicon.EXACT:
                    much = 1.0 if w == token else abuse._misspelt(own, len(w))
                    if much:
                        want[own] = max(much, want.get(own, 0))
        assert LEX._walk(list(token), 1) == want
        assert LEX._may(token) or not want


def test_fit():
    """The fit moves weights towards the verdicts, is the same for rows in any order, and leaves the priors without rows."""
    import pandas as pd

    rows = pd.DataFrame([(d, int(d % 2), "000abuse", "harm" if d % 2 else "weak", 1.0) for d in range(200)], columns=["doc_id", "toxic", "sentence", "feature", "value"])
    w = abuse.fitted(rows)
    assert w["harm"] > lexicon.PRIOR["harm"] and w["weak"] < lexicon.PRIOR["weak"]
    assert abuse.fitted(rows.sample(frac=1, random_state=3)) == w
    assert abuse.fitted(rows.iloc[:0]) == {}


def test_operator(spark):
    rows = [(1, BAD[0], "Forum ", 5), (1, BAD[0], "Forum ", 5), (2, FINE[0], "forum", 5), (3, None, None, 5), (4, "да " * 100_000, "x", 5), (None, BAD[1], "x", 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, score int")
    t = spark.createDataFrame([("мразь", "abuse"), (None, "hate"), ("слово", None)], "term string, category string")
    labels = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (2, "b", 0), (3, "a", None), (None, "a", 1), (4, "a", 0), (4, "b", 1)], "doc_id long, rater string, toxic int")
    s = abuse.scored(d, "doc_id", "text", t, labels)
    got = {r.doc_id: r.score for r in s.collect()}
    assert got[1] >= 0.5 and got[2] < 0.5 and got[3] == 0 and got[4] == 0 and None in got
    r = {x.source: (x.documents, x.flagged) for x in abuse.rates(d, s, "doc_id", "source").collect()}
    assert r["forum"] == (2, 1) and r[None] == (1, 0)
    assert abuse.scored(d.limit(0), "doc_id", "text", t.limit(0), labels.limit(0)).count() == 0
