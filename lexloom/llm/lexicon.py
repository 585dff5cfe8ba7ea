"""The general lexicon of abuse.py: classes of words, the rules that inflect them, and the weights one starts from.

Classes say what a word can be (an insult, an act of violence, a word that addresses somebody), not which sentences are
bad; that is left to weights of classes and of pairs of classes, which are fitted to reviewers' verdicts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

# Endings by which Russian words are inflected. A word marked n, a, v, f below is a stem that takes them.
ENDINGS = {
    "n": " а у ом ем ем е ы и ов ев ей ам ям ами ями ах ях ой ою я ю ь ью о".split(" "),
    "a": "ый ий ой ая яя ое ее ые ие ых их ого его ому ему ым им ыми ими ую юю ей ом ем".split(),
    # past and infinitive; present and future of the first and of the other conjugations
    "v": "ть ться л ла ли ло лся лась лись ло нный нная нные н на ны в вший вшая вши".split(),
    "p": "ы и е ов ев ей ам ям ами ями ах ях".split(),
    "f": "ю у ешь ёшь ет ёт ем ём ете ёте ут ют ишь ит им ите ат ят юсь усь ется ётся ются утся ится ятся ите и йте й".split(),
}

# Words by class. Words under en also take -s, verbs under ev also -s, -ed, -ing.
LEXICON = {
    "insult": {
        "n": "идиот кретин придурк мраз ублюдк дурак скотин сволоч подонк твар тупиц дебил урод уродин гнид мерзавц негодя ничтожеств убожеств отморозк мудак гадин выродк шваль быдл недоумк болван остолоп "
        "дегенерат имбецил олух потаскух шлюх паскуд засранц говнюк дерьм говн недочеловек бездар подлец подлюк мудил долбоёб гандон пизд падл лохушк чмошник имбецилк курв стерв недоросл дурын психопатк ублюдин",
        "as": "придурок ублюдок дура дуру дуры дурой подонок мерзавец отморозок выродок недоумок засранец гад гада гады гадов падаль лох чмо сдохлик",
        "en": "idiot scumbag cretin dumbass asshole arsehole halfwit moron bastard imbecile scum douchebag dipshit wanker twat cunt prick retard whore slut lowlife motherfucker fucker shithead fuckface nitwit dimwit "
        "blockhead bonehead simpleton degenerate piss-ant shitbag airhead dullard dickhead knobhead skank",
    },
    "weak": {
        "n": "человечишк позор мерзост отброс клоун посмешищ неудачник трус размазн тряпк слабак хам лжец мусор помо свол урк графоман крысёныш щенок глупц мразот нул",
        "as": "глупец создание пустое",
        "en": "loser jerk fool clown trash garbage freak coward creep filth wretch disgrace weirdo liar embarrassment crap shit turd hag maggot leech worm pervert snowflake",
    },
    "beast": {
        "n": "свинь сук козл осл коров собак кобел баран обезьян шавк жаб гадюк зме ишак",
        "as": "козёл осёл сука суки пёс псина свиней кобель курица курицы кур",
        "en": "pig cow dog rat bitch swine cur hound mutt donkey ape monkey snake toad hen weasel mongrel",
    },
    "you": {
        "as": "ты тебя тебе тобой тобою твой твоя твоё твое твои твоего твоей твоему твоим твоих твою вы вас вам вами ваш ваша ваше ваши вашу вашей ваших you your yours yourself yourselves u ya youre thou"
    },
    "third": {
        "as": "he she his her him hes shes they them their он она они ему ей него неё нее них этот эта эти этого этой that this those guy woman man neighbour"
    },
    "be": {"as": "are re r is am s m was were be being been быть просто всего лишь такой такая такие настоящий настоящая полный полная just nothing but such so really"},
    "wrote": {
        "n": "автор писател редактор",
        "as": "сочинил сочинила написал написала настрочил писать писала читать print printed printing wrote write writing writes publish published author writer whoever whoever's typed posted",
    },
    "what": {"as": "какой какая какое какие каков ну что what such absolute total complete utter полный конченый конченая редкостный редкостная"},
    "order": {
        "as": "проспись заткнись заткнитесь убирайся убирайтесь проваливай проваливайте позорься закрой закройте сгинь исчезни отвали отвалите катись вали бросай begone scram"
    },
    "contempt": {
        "n": "позор срам стыд отвращен",
        "a": "жалк никчёмн ничтожн бесполезн омерзительн мерзк отвратительн гнусн бездарн безмозгл тошнотворн конченн",
        "as": "презирают презирает презираю презираем противно тошно стыдно тошнит ненавижу ненавидят никчёмный бесполезный мерзкий жалкий",
        "en": "pathetic worthless disgusting useless miserable despicable disgrace despise hate embarrass embarrassing repulsive vile sickening laughable brainless spineless hopeless rotten loathsome contemptible ugly",
    },
    "brains": {"n": "мозг извилин", "as": "ума brain brains braincell sense"},
    "harm": {
        "v": "уби избива изби сломи слома перелома оторва разби зареза приби задуши закопа выби размаза искалечи вырва пристрели застрели повеси утопи сжеч перестреля перевеша перереза расстреля вздёрну бросит уничтожи переби высеч выпоро выброси придуши изнасилова пыта кастрирова",
        "as": "beaten shot hung burnt жечь убью зарежу прибью задушу закопаю пристрелю застрелю уничтожу придушу урою прикончу сжечь высечь выпороть бить бей бейте порвать",
        "ev": "kill smash crush break beat rip tear punch stab strangle choke shoot murder hurt slap kick drown whip cut snap bash hang break butcher gut slit slaughter lynch behead cripple destroy throttle skin flog torture rape pummel",
    },
    "harm1": {
        "as": "убью сломаю переломаю оторву разобью зарежу прибью задушу закопаю выбью размажу изобью искалечу вырву порву пристрелю застрелю сожгу уничтожу отрежу придушу зарою врежу урою раздавлю утоплю повешу прикончу покалечу"
    },
    "body": {
        "n": "рук ног голов ше рёбр зуб пальц лиц челюст горл черепушк кост морд спин",
        "as": "руки ноги голову шею рёбра ребра зубы пальцы лицо челюсть глотку горло кости морду хребет",
        "en": "leg arm face skull neck bone nose teeth head jaw finger hand knee throat rib spine eye ass limb gut",
    },
    "will": {"as": "will ll gonna going'll найду узнаю попадись попадёшься встречу поймаю достану приду wait find hunt track come swear"},
    "die": {"as": "сдохни сдохните подохни подохните умри умрите убейся убейтесь повесься удавись утопись застрелись kys"},
    "perish": {
        "v": "сдохну подохну сгини сгну помере сгоре утону",
        "as": "сдох сдохла сдохли сдохнешь сдохнет сдохнут сгинь сгинут сгинул сгниёшь подохнешь умер умерла гори горите провалиться",
        "ev": "die rot jump hang drown burn choke starve suffer perish bleed croak",
    },
    "would": {"as": "бы should would ought must shall надо нужно пора чтоб чтобы needs need deserves deserve let's somebody someone"},
    "hope": {"as": "чтоб пусть пускай hope let wish надеюсь желаю may"},
    "exist": {"as": "рождаться родиться рождались рождался рождалась родился родилась существовать жить дышать born exist existed alive breathe breathing live aborted"},
    "never": {"as": "лучше вовсе never better nobody незачем"},
    "group": {"as": "все всех всем всеми эти этих этим таких таким такие такими они их им народ племя all every these those them they their people folk folks kind tribe lot всякие каждый each"},
    "ident": {
        "p": "мигрант цыган евре мусульман христиан негр чужак иностранц беженц хохл москал азиат кавказц инородц гомосексуалист горц инвалид",
        "as": "бабы баб женщины женщин пришлые пришлых приезжие приезжих местные заречные верующие безбожники immigrants migrants foreigners refugees women jews muslims christians gypsies blacks whites gays "
        "lesbians homosexuals natives outsiders asians africans arabs mexicans peasants infidels villagers newcomers cripples lowlanders highlanders",
    },
    "slur": {
        "n": "жид чурк хач пидор пидорас педик черножоп узкоглаз черномаз чучмек",
        "as": "жиды чурки хачи пидоры пидорасы черножопые узкоглазые",
        "en": "nigger nigga faggot fag kike spic gook wop raghead towelhead tranny wetback coon darkie",
    },
    "filth": {
        "a": "грязн вонюч ленив туп поган глуп подл дик лжив продажн убог",
        "en": "filthy lazy stinking dirty stupid dumb thick greedy savage smelly inferior backward primitive ignorant evil dishonest",
    },
    "dehuman": {
        "n": "паразит скот крыс тварь отреб нелюд саранч дикар вредител зараз насеком клоп чум тараканы таракан варвар опухол",
        "as": "скоты скота скотов твари свиньи животные отребье нелюди саранча тараканы недолюди vermin rats animals parasite parasites pigs cockroach cockroaches roaches scum cattle beasts savages leeches subhuman "
        "subhumans plague disease cancer infestation locusts apes monkeys dogs swine trash filth garbage barbarians pest pests maggots",
    },
    "expel": {
        "v": "дави гна выгна вымес истребля истреби трави изгна веша жале вышвырну",
        "as": "давить гнать вымести истреблять выгнать травить вешать сгинут сгинуть жалеть изгнать вышвырнуть место выжечь депортировать убирались",
        "en": "driven exterminate exterminated wipe wiped mercy pity belong deserve deserved deported deport expel expelled eradicate eradicated purge purged cleanse banned hanged shot gassed removed sterilised sterilized rid drive",
    },
    "nonhuman": {"n": "нелюд", "as": "нелюди нелюдь недочеловеки subhuman subhumans"},
    "not": {"as": "не not aren isn ain t нет hardly barely"},
    "human": {"as": "люди людей людьми человек human humans people person"},
    "worse": {"as": "хуже worse lower dumber глупее тупее хитрее"},
    "vice": {
        "v": "ворова крад плоди граби вра обманыва убива спекулирова",
        "as": "плодятся воруют крадут врут лгут грабят обманывают воры вор бездельники преступники лентяи breed steal multiply lie cheat rob thieves thief criminals criminal liars rapists terrorists leech",
    },
    "act": {
        "v": "траха трахну совокупля сноша отсоса отыме еба выеба дрочи мастурбирова",
        "n": "оргазм минет куннилингус эякуляци совокуплени",
        "as": "кончил кончила кончили orgasm orgasms climaxed climaxing ejaculated fucked fucking fuck fucks blowjob masturbated masturbating intercourse copulated cumming cum",
    },
    "arouse": {
        "n": "секс любовник любовниц стон страст похот",
        "v": "раздвину ласка стона дрожа застона возбуди оседла простона",
        "a": "возбуждённ возбужденн горяч эрегированн",
        "as": "вошёл вошел входил проник упёрся двигался сексом лаская облизывал сосала сосал sex screwed slid pressed moaned moaning moan stroked stroking thrust thrusting panted lovers lover trembled entered aroused caressed caressing came licked licking sucked sucking spread penetrated groaned",
    },
    "bare": {
        "a": "гол обнажённ обнаженн",
        "n": "груд ягодиц задниц бедр бёдр сосок соск трусик лифчик",
        "as": "догола раздел раздела разделись раздевал одежду одежда сбросили голышом naked nude bare stripped undressed clothes breasts breast tits ass nipples nipple thighs thigh buttocks panties bra undressing",
    },
    "organ": {
        "n": "член пенис влагалищ клитор вагин промежност эрекци",
        "as": "член члена членом членом penis cock dick pussy vagina clit erection shaft crotch member groin manhood",
    },
    "mention": {"n": "слов словар термин выражени значени", "as": "пометой word words dictionary term terms phrase meaning means lexicon glossary spelling"},
    "med": {
        "n": "врач доктор осмотр снимок анализ пациент клиник больниц медицин анатоми урок учебник гигиен операци диагноз болезн",
        "en": "doctor screening examination exam patient clinic hospital medical medicine anatomy hygiene health disease surgery diagnosis nurse scan class education survey form questionnaire birth",
    },
    "art": {"n": "картин стату музе скульптур живопис художник фонтан галере рисунк полотн портрет", "en": "statue painting sculpture museum fountain gallery portrait artist canvas drawing marble photograph"},
    "farm": {
        "n": "урожа поместь порода пород фермер ветеринар хозяйств зерн амбар сара хлев ферм соседк хозяйк щенк кличк",
        "en": "harvest farm farmer pedigree breeder breed barn landlady crop grain stable vet puppy owner leash wheat field granary cellar sewer",
    },
    "law": {"n": "закон суд кодекс полици прокурор приговор стать", "as": "запрещает запрещено оскорблять law court forbids prohibits police judge sentenced prosecutor statute article code offence"},
    "idle": {"as": "время времени час вечер день time hour hours evening minutes lights engine battery appetite mood pain joke"},
    "game": {"n": "шахмат матч игр гонк партия парти", "as": "chess match game race cards tennis record film movie book season deal news"},
}

# Two words that together mean what neither does.
PHRASES = {
    ("drop", "dead"): "die", ("kill", "yourself"): "die", ("hang", "yourself"): "die", ("go", "die"): "die", ("убей", "себя"): "die", ("иди", "повесься"): "die", ("end", "yourself"): "die", ("go", "hang"): "die",
    ("shut", "up"): "order", ("shut", "your"): "order", ("stop", "embarrassing"): "order", ("waste", "of"): "weak", ("пошла", "вон"): "order", ("get", "lost"): "order", ("fuck", "off"): "order", ("закрой", "рот"): "order", ("закрой", "пасть"): "order", ("пошел", "вон"): "order", ("piss", "off"): "order", ("fuck", "you"): "die",
    ("had", "sex"): "act", ("having", "sex"): "act", ("have", "sex"): "act", ("made", "love"): "act", ("making", "love"): "act", ("занимались", "сексом"): "act", ("занимались", "любовью"): "act", ("заниматься", "сексом"): "act",
    ("не", "люди"): "nonhuman", ("not", "human"): "nonhuman", ("even", "human"): "nonhuman", ("not", "people"): "nonhuman", ("за", "людей"): "nonhuman", ("drag", "queen"): "game",
}

#: Classes of short, frequent words: found as written only, neither disguised nor misspelt.
EXACT = frozenset("you third be wrote what will would hope exist never group not human worse mention med art farm law idle game order brains ident".split())
#: Classes found by a misspelling too, and how many letters a word must have for that; with fewer (MISSPELT_SHORT) a hit counts less.
MISSPELT = {"insult": 6, "harm1": 6, "die": 6, "act": 7, "arouse": 7, "bare": 7, "organ": 7, "dehuman": 7, "weak": 7}
MISSPELT_SHORT = {"insult": 5}
# Beginnings of ordinary words that are one letter away from a term, so no misspelling of it.
ORDINARY = tuple(
    "morning castle striped cretan bustard custard mustard bastion imbib shore shred prink count truck lesser loose blasted dumber witch pitch ditch bench beach "
    "монет столом столов груда груше членик секста секунд любител любовь любим стари тварик паразитолог тупик дебит дебют скатерт дурман подол раздал ласточ лапка сказал тратил трогал хватал упала".split()
)
#: What bears on each category; a sentence without any of these is not looked at.
CATEGORIES = {
    "abuse": frozenset("filth insult weak beast harm harm1 die perish exist contempt order slur".split()),
    "hate": frozenset("dehuman filth expel nonhuman vice slur".split()),
    "sexual": frozenset("act arouse bare organ".split()),
}
CORE = frozenset().union(*CATEGORIES.values())
#: Classes that are said of somebody.
SAID = ("insult", "weak", "beast", "dehuman", "contempt", "filth", "vice", "slur")


def _prior() -> dict[str, float]:
    """The weights one starts from: one of each class, then of pairs (a~b within the window, a>b said of a, a|b side by side)."""
    own = {"bias": -4.0, "insult": 1.0, "weak": 0.5, "harm": 0.3, "harm1": 1.5, "die": 4.3, "perish": 0.3, "contempt": 0.3, "slur": 4.3, "dehuman": 0.5, "filth": 0.3, "expel": 0.5, "nonhuman": 2.5, "vice": 0.5, "act": 3.0, "arouse": 0.3, "bare": 0.2, "organ": 0.5, "words2": 0.7, "words3": 1.5}
    together = {
        "insult": "you 2 wrote 2.5 what 2 order 3.2 die 3 not -1 weak 1.5 beast 1.5 contempt 1.5 insult 1.5 harm1 2.5 group 1 filth 1.5 expel 2 mention -0.5 law -2 perish 2 ident 1.5",
        "weak": "you 2 wrote 2 what 2 order 2 contempt 1.5 beast 1 insult 1.5 weak 0.5 exist 1 law -2 mention -2",
        "beast": "you 0.8 wrote 2 what 1.5 order 2.5 contempt 1.5 farm -3 art -2 brains 1",
        "harm": "you 2 body 1.5 will 2 would 2.2 wrote 2 hope 0.5 idle -5 game -3 law -1.5 ident 1.5 group 0.5 insult 2",
        "harm1": "you 2.2 body 2 insult 2.5 will 2 idle -3 beast 2 weak 2",
        "die": "you 0.5 insult 1 wrote 0.5 beast 1 not -0.3 group 0.5",
        "perish": "you 1.6 would 1.5 wrote 2 hope 2.5 insult 1.5 weak 1.5 expel 1 ident 1.5 group 0.7 contempt 1",
        "exist": "never 2.2 would 1 you 1.6 insult 1.5 weak 1 contempt 1 not 0.5",
        "contempt": "contempt 1.2 you 2 wrote 2 order 1 insult 1.5 weak 1.5 group 0.5 ident 2 art -1 game -1.5",
        "order": "you 0.7",
        "slur": "mention -2 law -1.5 group 0.5",
        "dehuman": "would 1.5 harm 1.5 group 2 filth 1.5 expel 2 worse 2 ident 2.5 farm -4 vice 1.5 law -1.5 med -1.5 not 0 human 0.5 nonhuman 1",
        "filth": "group 0.7 expel 1.5 ident 1.8 vice 1.5 human 0.3",
        "expel": "group 1 ident 2 vice 1.8 nonhuman 2 worse 1 expel 0.3 law -1.5 human 0.5",
        "nonhuman": "group 1.8 ident 2 expel 1.5 hope 1.5 third 0.5 worse 1",
        "vice": "vice 1.5 group 1 ident 1.8 law -2",
        "act": "arouse 1.5 bare 1.5 organ 1.5 third 1.5 you 0.5 med -4 farm -3 law -2 mention -3 beast -2",
        "arouse": "body 1.5 bare 2 third 0.8 organ 2 arouse 1 med -2 art -2 farm -2",
        "bare": "organ 1.5 med -3 art -3 bare 0.3",
        "organ": "med -3 farm -3 art -2 third 1.2",
    }
    for a, text in together.items():
        parts = text.split()
        own |= {"~".join(sorted((a, b))): float(x) for b, x in zip(parts[::2], parts[1::2], strict=True)}
    own |= {"you>insult": 1.5, "you|insult": 2.0, "you>weak": 2.0, "you|weak": 2.0, "you>beast": 2.0, "you|beast": 2.5, "you>contempt": 0.7, "you>dehuman": 2.0, "you|dehuman": 1.0, "you>slur": 0.5, "you>filth": 3.2, "you|contempt": 1.0, "ident|filth": 2.0}
    own |= {"third>insult": 3.2, "third>weak": 2.5, "third>slur": 0.5, "ident>dehuman": 1.5, "ident>filth": 2.0, "ident>vice": 2.0, "ident>insult": 1.5, "ident>contempt": 1.0, "ident>weak": 1.5}
    return own


PRIOR = _prior()


def forms(extra: Iterable[tuple[str, str]] = ()) -> Iterator[tuple[str, str]]:
    """(word, class) of every form of every word of the lexicon and of further (term, class)."""
    for own, kinds in LEXICON.items():
        for kind, text in kinds.items():
            for w in text.split():
                if kind == "as":
                    yield w, own
                elif kind in ("en", "ev"):
                    yield from ((f, own) for f in english(w, kind == "ev"))
                else:
                    yield from ((w + e, own) for e in ENDINGS[kind])
    for term, own in extra:
        term = term.strip().lower()
        if "а" <= term[:1] <= "я" or term[:1] == "ё":
            yield term, own
            if len(term) > 4:
                stem = term.rstrip("аяоеьый")
                yield from ((stem + e, own) for e in ENDINGS["a" if term[-2:] in ("ый", "ий", "ой") else "n"] if len(stem) > 2)
        elif term:
            yield from ((f, own) for f in english(term))


def english(w: str, verb: bool = False) -> list[str]:
    """An English word with the endings it may take: -s, and if it is a verb -ed and -ing."""
    if w.endswith("y") and w[-2:-1] not in "aeiou":
        return [w, w[:-1] + "ies", *([w[:-1] + "ied", w + "ing"] if verb else [])]
    out = [w, w + ("es" if w[-1] in "shxz" else "s")]
    if verb:
        base = w[:-1] if w.endswith("e") else w
        double = w + w[-1] if len(w) <= 5 and w[-1] in "bdgmnprt" and w[-2:-1] in "aeiou" and w[-3:-2] not in "aeiou" else base
        out += [base + "ed", double + "ed", base + "ing", double + "ing"]
    return out
