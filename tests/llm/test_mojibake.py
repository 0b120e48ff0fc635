import random

from hypothesis import given
from hypothesis import strategies as st

from lettermill.llm import mojibake as M

SCHEMA = "seq bigint, subject string, `from` string, attachment_filenames string, field string, restored int"
SUBJECTS = ["Situação do orçamento {}", "Rückfrage zur Prüfung {}", "Relatório de inspeção nº {}", "Größenänderung Muster {}", "Договор {} на подпись", "会議の件 {}", "Naïve forecast {}", "Dúvida quanto à medição {}", "Störung im Gebäude {}", "5 Ω resistor order {}", "Área de {} m² liberada"]
CHAINS = [(("utf-8", "latin_1"),), (("utf-8", "cp437"),), (("utf-8", "cp1252"), ("utf-8", "cp1252")), (("cp1252", "cp850"),), (("cp1251", "latin_1"),)]


def frame(spark, rows):
    return spark.createDataFrame([(k, s, f, a, "clash", 1) for k, (s, f, a) in enumerate(rows)], SCHEMA)


@given(st.text("aZ éàçñüßØœДя日本²º", max_size=20))
def test_chains_are_undone(text):
    for chain in M.all_chains():
        g = M.garble(text, chain)
        if g is not None and M.LOST not in g:
            assert M.restore(g, chain) in (text, None) or chain[0][0] in ("euc_jp", "cp932", "gbk", "big5", "euc_kr")


def test_held_out_accuracy(spark):
    rng, rows, truth = random.Random(5), [], {}
    for k in range(2500):
        clean = rng.choice(SUBJECTS).format(rng.randint(1, 99999))
        shown = clean
        if rng.random() < 0.12:
            g = M.garble(clean, rng.choice(CHAINS))
            if g is not None and g != clean:
                shown, truth[k, "subject"] = g, clean
        rows.append((shown, "Zoë Müller", "Prüfung.pdf|résumé, v2.doc"))
    got = {(r.seq, r.field): r.restored for r in M.damaged_values(frame(spark, rows)).collect()}
    right = sum(got.get(k) == v for k, v in truth.items())
    assert right >= 0.97 * len(truth) and len(got) - right <= 0.02 * len(truth)


def test_part_of_a_list_and_lost_characters(spark):
    rows = [("Rückfrage zur Prüfung 1", "Jürgen", "Prüfung.pdf|Übersicht 1.doc|für.txt")] * 40
    rows += [("RÃ¼ckfrage zur PrÃ¼fung 1", "JÃ¼rgen", "Prüfung.pdf|Ãœbersicht 1.doc|fÃ¼r.txt"), ("R�ckfrage", None, "")]
    got = {(r.seq, r.field): r.restored for r in M.damaged_values(frame(spark, rows)).collect()}
    assert got == {(40, "subject"): "Rückfrage zur Prüfung 1", (40, "from"): "Jürgen", (40, "attachment_filenames"): "Prüfung.pdf|Übersicht 1.doc|für.txt", (41, "subject"): ""}


def test_edges(spark):
    assert M.damaged_values(frame(spark, [(None, None, None)]).limit(0)).count() == 0
    assert M.damaged_values(frame(spark, [(None, "", "plain"), ("é" * 50_000, None, None), ("x�", None, None), ("x�", None, None)])).count() == 2


def test_texts_without_latin_letters_are_learnt_from(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("абвгдежиклмнопрстуфхцчшыэюя") for _ in range(rng.randint(4, 9)))
    clean = [" ".join(word() for _ in range(12)).capitalize() for _ in range(60)]  # one group, no form above a 50th of it, runs of over 64 letters
    bad = [M.garble(c, (("koi8_r", "cp1251"),)) for c in clean[:6]]
    rows = [(c, None, None) for c in clean * 8] + [(b, None, None) for b in bad]
    got = {r.seq: r.restored for r in M.damaged_values(frame(spark, rows)).collect()}
    assert got == {len(clean) * 8 + k: clean[k] for k in range(6)}
