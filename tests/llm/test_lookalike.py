import pytest
from hypothesis import given
from hypothesis import strategies as st

from lettermill.llm import lookalike as L


@pytest.mark.parametrize(
    ("shown", "plain"),
    [
        ("Ｄｅｌｉｖｅｒｙ ｎｏｔｅ ２０", "Delivery note 20"),
        ("Prοjekt А", "Projekt A"),
        ("Manutenção dο elevаdоr", "Manutenção do elevador"),
        ("Ac‍t‍⁠a abril", "Acta abril"),
        ("\xadAVALIAÇÃO DA\xad‌ X", "AVALIAÇÃO DA X"),
        ("Nota ﬁscal 71\xa0x", "Nota fiscal 71 x"),
        ("Café", "Café"),
        ("Naїvе", "Naïve"),
        ("Сongе́s étе́", "Congés été"),
        ("Отчёт за меcяц 5", "Отчёт за месяц 5"),
        ("　会議の件", " 会議の件"),
    ],
)
def test_imitations(shown, plain):
    assert L.canonical(shown) == plain
    assert L.comparison_key(shown) == L.comparison_key(plain.upper()) or "ß" in plain


@pytest.mark.parametrize("text", ["5 Ω resistor", "5 Ω", "2ª via nº 3 m²", "½ ™ №", "Onboarding 👩‍💻 week", "Договор на подпись", "RE: Счёт", "見積書について", "نامه‌ها", "ça va", "Ελλάδα και Κύπρος", ""])
def test_left_alone(text):
    assert L.canonical(text) == text


@given(st.text(max_size=40))
def test_stable(text):
    once = L.canonical(text)
    assert L.canonical(once) == once


def test_rows(spark):
    schema = "seq bigint, subject string, `from` string, attachment_filenames string, canonical int"
    rows = [(1, "Prοjekt", None, None, 1), (1, "Prοjekt", None, None, 1), (2, "", "Ａnn", None, 1), (3, None, None, None, 1), (4, "Ω", "�\xa0x", None, 1), (None, "Ｘ" * 60_000, None, None, 1)]
    got = sorted(((r.seq or 0, r.field, r.canonical) for r in L.imitations(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == [(0, "subject", "X" * 60_000), (1, "subject", "Projekt"), (1, "subject", "Projekt"), (2, "from", "Ann")]
    assert L.imitations(spark.createDataFrame([], schema)).count() == 0


def test_signs_stay_and_compatibility_letters_go():
    import re

    assert L.canonical("10 \u00b5F \u2013\u00a0x") == "10 \u00b5F \u2013 x" and L.canonical("10 \u00b5F") == "10 \u00b5F"
    suspect = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m.group(1), 16)), L.SUSPECT))
    for n in range(0x80, 0x250):
        assert bool(suspect.search(chr(n))) == (L.canonical(chr(n)) != chr(n))
