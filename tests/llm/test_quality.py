from lettermill.llm import quality as Q

PROSE = [
    "The board has checked all the invoices from last month, which surprised all of us. She lost the keys and it was not easy for them.",
    "> He will need an updated plan for the\n> move before the meeting on Thursday. We\n> should not wait until the roof leaks.",
    "WE SHOULD NOT WAIT UNTIL THE ROOF LEAKS AGAIN. THE TEAM HAS APPROVED A SHORT NOTE ON THE DELAY",
    "Thanks, that works for me.",
    "Dear all,\n\n- chair\n- lamp x3\n\nThe auditor cannot accept the list of open points before the meeting on Thursday, but she has approved the second draft of the lease and it was not easy.",
]
OTHER = [
    "83803,Schrauben,1834.75,urgent\n49450,gloves,3171.20,n/a\n41320,valve,3769.57,done",
    "- chair x3\n- lamp\n- seed bag;\n- toner x9\n- valve / pump",
    "| 11137 | bolt | 4042.46 |\n|---|---|---|\n| 21316 | chair | 3710.64 |",
    "$|% $^•§|¶ %¶■■ $■@^~§% |¶§¶%§$ @¶$%$%¶^¶ |¶@~~",
    "13:35:02 ERROR [5] job.Disk#poll rc=114 id=44538fd\n17:27:35 WARN [95] job.Mail#poll rc=204 id=4668a2",
    "ed 20 80 7a 64 e9 0f 5f da 03 7d 70 89 a6 22 10\ne5 b1 ca f2 f0 a2 3b f2 19 c6 2d c9 60 e2 ac e9\ndc 61 d5 59 8e 9e 10 8a 1d e2 9b 4f 00 71 c2 0d",
]
WORDS = [("en", w) for w in "the has all from of us she and it was not for them he will need an before on we should until again a that me but cannot is".split()]


def run(spark, texts, words=WORDS):
    docs = spark.createDataFrame([(k, t, "x", 0.5) for k, t in enumerate(texts)], "doc_id bigint, text string, text_type string, other_share double")
    return docs, spark.createDataFrame(words, "lang string, word string")


def test_types(spark):
    docs, words = run(spark, PROSE * 20 + OTHER * 8)
    got = {r.doc_id for r in Q.found(docs, words).collect()}
    assert got == set(range(len(PROSE) * 20, len(PROSE) * 20 + len(OTHER) * 8))


def test_statistics(spark):
    docs, words = run(spark, ["One two, three.\nfour", None, "", " \r\n\t"])
    rows = {r.doc_id: r for r in Q.text_types(docs, words).collect()}
    assert rows[0].n_words == 4 and rows[0].mean_word_length == 15 / 4 and rows[0].end_punctuation_share == 0.5 and rows[0].words_per_line == 2
    assert [rows[k].text_type for k in (1, 2, 3)] == ["empty"] * 3


def test_edges(spark):
    docs, words = run(spark, [])
    assert Q.found(docs, words).count() == 0 and Q.text_types(docs, words).count() == 0
    docs, words = run(spark, [None, "", PROSE[0] * 2000, PROSE[0] * 2000, None], [])
    assert Q.found(docs, words).count() == 0 and Q.text_types(docs, words).count() == 5


def test_em_weighs_functions_by_agreement():
    k = len(Q.FUNCTIONS)
    sure = [([3 * j + v for j in range(k)], 100) for v in (Q.PROSE, Q.OTHER)]
    # the last function votes at random
    noisy = [([*range(v, 3 * (k - 1), 3), 3 * (k - 1) + u], 50) for v in (0, 1) for u in (0, 1)]
    bias, w = Q.learn(noisy)
    assert abs(w[3 * (k - 1)] - w[3 * (k - 1) + 1]) < 0.2 and w[1] - w[0] > 3
    bias, w = Q.learn(sure)
    assert bias + sum(w[3 * j + 1] for j in range(k)) > 0 > bias + sum(w[3 * j] for j in range(k))
