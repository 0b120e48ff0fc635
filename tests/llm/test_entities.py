import pytest
from hypothesis import given
from hypothesis import strategies as st

from lettermill.llm import entities as E

BOOK = [
    (1, "person", "Thomas Ernst Phelibrook", None),
    (2, "person", "Octavia Sölmibrook", "o@x.io"),
    (3, "person", "Richard Quindindela", None),
    (4, "person", "Katherine Yervindela", None),
    (5, "person", "Heloísa Mazzuveira Grüdasconi", None),
    (6, "organisation", "Graviquist International SARL", None),
    (7, "organisation", "Umbronova Informatique Ltd", None),
    (8, "person", "Rita Quindindela", None),
]
SCHEMA = "entity_id bigint, kind string, display_name string, mail_address string"


@pytest.mark.parametrize(
    ("name", "entity"),
    [
        ("Phelibrook, T.", 1), ("TE Phelibrook", 1), ("PHELIBROOK Thomas", 1), ("Dr. Thomas Phelibroko", 1), ("thomas_phelibrook", 1), ("Tho. Phelibrook", 1), ("Thomas Phelibrook - Sales", 1),
        ("OctaviaSölmibrook", 2), ("Octavia Soelmibrook", 2), ("Octavia R. Solmibrook (TI)", 2), ("Heloísa Grüdasconi", 5), ("Mazzuveira-Grüdasconi, Heloisa", 5),
        ("Graviquist Intl", 6), ("The Graviquist International S.A.R.L.", 6), ("International Graviquist", 6), ("Umbronova Info. Ltd", 7), ("Graviquist", 6),
        ("R. Quindindela", None), ("Margaret Quindindela", None), ("Sölmibrook", None), ("Umbronova Engineering Inc.", None), ("", None), ("Q" * 5000, None), ("a b " * 40, None),
    ],
)
def test_matching(name, entity):
    got = [x for x in E.Matcher(E.profiles_of([b[:3] for b in BOOK])).match(name) if not x[2]]
    best = [x[1] for x in got if x[0] <= got[0][0] + 1e-9]
    assert best == [entity] if entity else len(best) != 1


@given(st.text("abcd", max_size=7), st.text("abcd", max_size=7))
def test_deletions_find_what_distance_allows(a, b):
    n = E.distance(a, b, 2)
    if n <= 2 and min(len(a), len(b)) > 2:
        assert E.deletions(a, 2) & E.deletions(b, 2)
    assert E.distance(b, a, 2) == n


@given(st.text("ab", min_size=27, max_size=40), st.lists(st.tuples(st.integers(0, 26), st.sampled_from("+-~x")), max_size=2))
def test_long_words_share_a_key_too(word, changes):
    typed = word
    for at, kind in changes:
        typed = {"+": typed[:at] + "c" + typed[at:], "-": typed[:at] + typed[at + 1 :], "~": typed[:at] + typed[at + 1 : at + 2] + typed[at : at + 1] + typed[at + 2 :], "x": typed[:at] + "c" + typed[at + 1 :]}[kind]
    assert E.distance(word, typed, 2) > 2 or E.deletions(word, 2) & E.deletions(typed, 2)


def test_names_of_any_length_match():
    m = E.Matcher(E.profiles_of([b[:3] for b in BOOK] + [(12, "organisation", " ".join(f"Wort{c}lang" for c in "abcdefghijklm")), (13, "person", "Otto " + "Kraxenbichl" * 4)]))
    assert [x[1] for x in m.match(" ".join(f"wort{c}lang" for c in "abcdefghijklm"))] == [12]
    assert [x[1] for x in m.match("Otto " + "Kraxenbichl" * 3 + "Kraxnebichl")] == [13]
    assert E.written_name("Phelibrook, T." + " " * 5000 + "<t@x.io>") == "Phelibrook, T."


def test_parts_of_the_book_change_nothing(spark, monkeypatch):
    book = spark.createDataFrame([(1, "person", "Maria Keller", None), (2, "person", "Mario Kellner", None), (2, "person", "Mario Kellnerson", None)], SCHEMA)
    names = spark.createDataFrame([("Mario Keller",), ("M. Kellner",)], "name string")
    whole = sorted(map(tuple, E.linked_names(names, book).collect()))
    monkeypatch.setattr(E, "BOOK_PART", 1)
    assert sorted(map(tuple, E.linked_names(names, book).collect())) == whole == [("M. Kellner", 2), ("Mario Keller", 2)]


def test_rows(spark):
    book = spark.createDataFrame(BOOK, SCHEMA)
    kate = ["Kate Yervindela", "Yervindela, Kate", "Kate Yervindella"]
    rows = [(k, n, None, None) for k, n in enumerate(kate)]
    rows += [
        (10, '"Octavia Sölmibrook" <z@x.io>', "octavia sölmibrook; Phelibrook, T. <o@x.io>", "o@x.io"),
        (11, "Ｏｃｔａｖｉａ Sölmibrook", "Oсtavia Sölmibrok", ""),
        (12, None, None, "T. Phelibrook, Thomas Phelibrook, Dr. Thomas Phelibrook"),
        (12, None, None, "T. Phelibrook, Thomas Phelibrook, Dr. Thomas Phelibrook"),
        (None, "Phelibrook, T.", None, None),
    ]
    df = spark.createDataFrame([(*r, None, None, 5) for r in rows], "seq bigint, `from` string, to string, cc string, subject string, attachment_filenames string, entity_id int")
    got = sorted(map(tuple, E.linked_rows(df, book).collect()))
    # the short form that both spellings of one family name agree on is learnt
    assert got == [(0, "from", 4), (1, "from", 4), (2, "from", 4), (10, "to", 1), (11, "to", 2), (12, "cc", 1)]
    assert E.linked_rows(df.limit(0), book).count() == 0
    assert E.linked_rows(df, book.limit(0)).count() == 0


def test_merged_names_enrich_their_profiles(spark):
    book = spark.createDataFrame([*BOOK, (9, "person", "William Tarnwick", None), (10, "person", "William Zorvald", None), (11, "organisation", "Kelvotek Informatique SA", None)], SCHEMA)
    names = [
        ("Octavia R. Sölmibrook", 2), ("OR Sölmibrook", 2), ("Octavia Regina Sölmibrook", 2),  # a middle initial, then what it opens
        ("Richard T. Quindindela", 3), ("R. T. Quindindela", 3), ("R. Quindindela", None),  # it tells two namesakes apart, nothing else does
        ("Billie Tarnwick", 9), ("Tarnwick, Billie", 9), ("Billie Zorvald", 10), ("B. Tarnwick", 9), ("Bilile Zorvald", 10),  # initial and slip of a short name
        ("Umbronova Datentechnik", 7), ("Kelvotek Datentechnik", 11), ("Graviquist Engineering", None), ("GRAVIQUIST ENGINEERING Ltd", None),  # two organisations agree
    ]
    got = {r.name: r.entity_id for r in E.linked_names(spark.createDataFrame([(n,) for n, _ in names], "name string"), book).collect()}
    assert got == {n: e for n, e in names if e}
