import random

import numpy as np

from ledgerquarry.llm import subjects as S

NOUNS = {"steel": ["beam", "girder", "coil", "plate", "purlin"], "law": ["clause", "claim", "counsel", "notice", "waiver"], "freight": ["truck", "pallet", "escort", "depot", "waybill"]}
FORMS = ["The {} differs from the {} we agreed on.", "There are 12 open points about the {} and one about the {}.", "Can you look? The {} still needs the {}.", "On 3 May the {} and the {} were both moved."]
FILL = ["Thanks for getting back to me so soon.", "Sorry for the late reply, it was a long week."]


def corpus(n, seed=1):
    rng, docs, truth = random.Random(seed), [], []
    for i in range(n):
        main = rng.choice(list(NOUNS))
        other = rng.choice([s for s in NOUNS if s != main])
        k, m = rng.choice([(8, 0)] * 4 + [(8, 1), (5, 4)])
        said = [rng.choice(FORMS).format(rng.choice(NOUNS[s]), rng.choice(NOUNS[s])) for s in [main] * k + [other] * m]
        said += [rng.choice(FILL)]
        rng.shuffle(said)
        docs.append((i, " ".join(said), "en" if rng.random() < 0.9 else None, "x"))
        truth.append({main, other} if m == 4 else {main})
    return docs, truth


def run(spark, docs, labels, **k):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, share string")
    got = {}
    subjects = spark.createDataFrame([(s,) for s in NOUNS], "subject string")
    for r in S.assign_subjects(d, spark.createDataFrame(labels, "doc_id bigint, subject string"), subjects, **k).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
        assert 0 <= r.posterior <= 1
    return got


def test_held_out_accuracy(spark):
    docs, truth = corpus(400)
    labels = [(i, s) for i in range(0, 400, 3) for s in truth[i]] + [(1, "law"), (999999, "law"), (None, "law"), (3, None), (0, "unheard of")]
    got = run(spark, docs, labels)
    assert np.mean([got.get(i) == truth[i] for i in range(400) if i % 3]) > 0.95


def test_edges(spark):
    docs, truth = corpus(60)
    odd = [(1000, None, "en", ""), (1001, "", "en", ""), (1002, "Thanks for getting back to me so soon.", None, ""), (1003, docs[0][1] * 200, "xx", ""), (0, docs[0][1], "en", "")]
    got = run(spark, docs + odd, [(i, s) for i in range(60) for s in truth[i]])
    assert not {1000, 1001, 1002} & set(got) and got[0] == truth[0]
    assert run(spark, docs, []) == {} and run(spark, [], [(1, "law")]) == {}


def test_sentences():
    text = "One is here. Can you? The two still needs it.\n\n- list item (x)\nThree! > quoted"
    assert [s.strip() for s in S.sentences(text)] == ["One is here.", "Can you? The two still needs it.", "- list item (x)", "Three!", "quoted"]


def test_slope():
    rng = np.random.default_rng(1)
    x = rng.uniform(-0.5, 0.5, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-15 * x))).astype(float)
    assert abs(S.fit_slope(x, y) - 15) < 1.5
    assert S.fit_slope(x[:0], y[:0]) == 12.0 and S.fit_slope(x, np.ones(4000)) == 12.0


def test_language_by_the_whole_text():
    words = ["le la les et une est chez pour du"] * 2 + ["the and of to was for has this that with"] * 300
    docs = [(1, ". ".join(words), None), (2, "der die das und ist", None)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t, "lang": lang, "labels": None, "held": None} for i, t, lang in docs], schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("labels", pa.list_(pa.int32())), ("held", pa.list_(pa.int32()))]))
    out = next(iter(S._featurise(16, ["en", "fr", "de"])(iter([batch]))))
    assert out.column("lang").to_pylist() == [0, 2]
