import pytest

from memspark.llm import pii

SCHEMA = "id string, content string, uid string, spans string, kind string, term string"


def kinds(text):
    return {(text[a:b], k) for a, b, k, _, cued in pii.candidates(text) if cued and k != "person"}


@pytest.mark.parametrize(
    ("text", "item", "kind"),
    [
        ("write to a.b+c@mail.host.example now", "a.b+c@mail.host.example", "email"),
        ("to <mailto:a_b%40host.test>", "a_b%40host.test", "email"),
        ("ask ann dot lee at host dot example soon", "ann dot lee at host dot example", "email"),
        ("邮箱ann＠host.test，谢谢", "ann＠host.test", "email"),
        ("ann [at] host [dot] invalid", "ann [at] host [dot] invalid", "email"),
        ("call +1 555 555 0123.", "+1 555 555 0123", "phone"),
        ("打19900001234。", "19900001234", "phone"),
        ("tel (0)", None, None),
        ("line 020 7946 0000, old", "020 7946 0000", "phone"),
        ("+44 (0)7700 900 000 ext. 7", "+44 (0)7700 900 000 ext. 7", "phone"),
        ("电话(0999) 0000-1234", "(0999) 0000-1234", "phone"),
        ("no QQ 12 34 56 C here", "QQ 12 34 56 C", "id_number"),
        ("ssn 901-23-4567!", "901-23-4567", "id_number"),
        ("身份证号11010519491231002X，", "11010519491231002X", "id_number"),
        ("id 110105 19491231 002X", "110105 19491231 002X", "id_number"),
        ("trace 110105194912310021 twice", None, None),
        ("at Flat 2B, 12 Elm Row, Town 00123.", "Flat 2B, 12 Elm Row, Town 00123", "address"),
        ("at 12 ELM ROAD, suite 9", "12 ELM ROAD, suite 9", "address"),
        ("in Lindenweg 4, 00123 Ort", "Lindenweg 4, 00123 Ort", "address"),
        ("搬到了青川市云台区临水路12号。", "青川市云台区临水路12号", "address"),
        ("pin kit@1.2.3 and @retry(times=3), 219 rows, build 1.22.33", None, None),
        ("batch 2025-02-03, no 1064665253, epoch 1766113659847, 78-7670-23", None, None),
    ],
)
def test_forms(text, item, kind):
    assert kinds(text) == ({(item, kind)} if item else set())


TEXTS = [
    "talked to Ann Holt about it",
    "Holt, Ann signed off. The user said that the end is near.",
    "As A. Holt put it, fine. Mail ann.holt@host.test",
    "dr. ann b. holt-mire -> approved",
    "本条由晏屿确认。晏屿说不改。",
    "The user said that it works, the user said so",
    "Ann Holt wins, Green Field too",
    *[f"the user and the file {i} are as here as in a row of the end" for i in range(30)],
]


def frame(spark, texts):
    rows = [(str(i) if t != "x" else None, t, "x", "x", "x", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def test_names_by_disclosure(spark):
    df = frame(spark, [*TEXTS, None, "", "x", TEXTS[0]])
    found = {(r.id, TEXTS[int(r.id) % 38 if int(r.id) < len(TEXTS) else 0][r.a : r.b]) for r in pii.find(df, ["id"], "content").filter("kind = 'person'").collect()}
    assert {("0", "Ann Holt"), ("1", "Holt, Ann"), ("2", "A. Holt"), ("4", "晏屿"), ("6", "Ann Holt")} <= found
    assert not [f for f in found if f[0] == "5" or "user" in f[1] or "Green" in f[1]]
    assert any(i == "3" for i, _ in found)


def test_sanitised_keeps_the_rest(spark):
    df = frame(spark, [*TEXTS, None, "", TEXTS[0], "-" * 20000 + " ann@host.test"])
    got = {r.id: r.sanitised for r in pii.sanitise(df, ["id"], "content").collect()}
    n = len(TEXTS)
    assert got["0"] == got[str(n + 2)] == "talked to [PERSON] about it"
    assert got["2"] == "As [PERSON] put it, fine. Mail [EMAIL]"
    assert got["4"] == "本条由[PERSON]确认。[PERSON]说不改。"
    assert got["5"] == TEXTS[5] and got[str(n)] is None and got[str(n + 1)] == ""
    assert got[str(n + 3)] == "-" * 20000 + " [EMAIL]"


def test_names_after_capitalised_words_and_uncued_chinese_names(spark):
    cued = [f"talked to Jane Holt about {i}. 本条由晏屿确认。" for i in range(4)]
    away = {"Yesterday Jane Holt came": "Jane Holt", "Kollege Hans, Jane Holt ging": "Jane Holt", "Thanks, Jane Holt": "Jane Holt", "昨天晏屿来了": "晏屿"}
    plain = ["Yesterday Green Field was open", "昨天屿晏来了", "晏的屿"]
    filler = [f"the user and the file {i} are as here as in a row of the end 我们今天把文件放在这里" for i in range(30)]
    texts = [*cued, *away, *plain, *filler]
    found = [(texts[int(r.id)], texts[int(r.id)][r.a : r.b]) for r in pii.find(frame(spark, texts), ["id"], "content").filter("kind = 'person'").collect()]
    assert sorted(f for f in found if f[0] not in cued) == sorted(away.items())
    got = {texts[int(r.id)]: r.sanitised for r in pii.sanitise(frame(spark, texts), ["id"], "content").collect()}
    assert all(got[t] == t.replace(n, "[PERSON]") for t, n in away.items()) and all(got[t] == t for t in [*plain, *filler])


def test_long_names_and_sentences_of_other_texts(spark):
    long = "Anna-" + "Friederike-Wilhelmina-Charlotte-" * 8 + "Luise Holt"
    want = {"I met Sarah Johnson at the cafe yesterday.": "Sarah Johnson", "My colleague Priya Natarajan called.": "Priya Natarajan", "Our accountant is Tomás García.": "Tomás García", f"{long} said so.": long, f"As he heard, {long} wrote back.": long, "Dr. Omar Haddad came by": "Omar Haddad", "我告诉王小明，今天不来": "王小明"}
    plain = ["The lock manager should own this.", "THE MANAGER ASKED CLOCK DRIFT", "The system called Green Field is open", "I asked the team twice"]
    texts = [*want, *plain, *[f"the user and the file {i} are as here as in a row of the end; asked the team, the system is a green field 我们今天把文件放在这里" for i in range(40)]]
    found = [(texts[int(r.id)], texts[int(r.id)][r.a : r.b]) for r in pii.find(frame(spark, texts), ["id"], "content").filter("kind = 'person'").collect()]
    assert sorted(f for f in found if f[0] not in plain) == sorted(want.items())
    assert not [f for f in found if f[0] in plain and f[0] != plain[2]]


def test_places_are_learnt(spark):
    """No list holds the surroundings "strolls past", yet the corpus shows that persons stand before it."""
    names = [f"{a} {b}" for a in ("Jane", "Omar", "Priya") for b in ("Holt", "Haddad", "Lind")]
    texts = [*[f"I met {n} in {i}." for i, n in enumerate(names)], *[f"{n} strolls past the gate." for n in names], "jane quill strolls past the gate.", *[f"the user and the file {i} are as here as in a row of the end" for i in range(40)]]
    assert ("after", "strolls past", True) in pii.places(frame(spark, texts), "content", pii.Disclosure())
    found = {(r.id, texts[int(r.id)][r.a : r.b]) for r in pii.find(frame(spark, texts), ["id"], "content").filter("kind = 'person'").collect()}
    assert ("18", "jane quill") in found and {(str(9 + i), n) for i, n in enumerate(names)} <= found


def test_empty(spark):
    df = frame(spark, [])
    assert pii.find(df, ["id"], "content").count() == 0
    assert pii.sanitise(df, ["id"], "content").count() == 0
