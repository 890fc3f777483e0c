"""Reading of payloads, weak labels, and held-out accuracy of the classifier."""

import json
import random
from collections import Counter

import pytest

from quern.llm import residue as r

MENTIONS = [
    'Bị đơn cho rằng máy chủ báo "Internal Server Error" vào giờ chấm công nên dữ liệu ngày 5 không được ghi nhận.',
    "Khi nộp hồ sơ trực tuyến, người nộp nên dùng trình duyệt có bật JavaScript và giữ lại mã biên nhận.",
    "Họ và tên: ..........................", 'Nguyên đơn nêu: "[...] tôi đã nhận đủ lương" [3].',
]
RESIDUE = ["Số: {{so_hieu}}", "Access Denied. You do not have permission to view this directory or page.", "Vui lòng bật JavaScript trong trình duyệt để xem nội dung văn bản này.", "Lorem ipsum dolor sit amet consectetur adipiscing elit", "Ngày: ${ngay_ban_hanh}", "Người sử %%SO_HIEU%% lao động có quyền."]


def prose(rnd):
    return f"{rnd.choice(['Người lao động', 'Hội đồng cơ sở', 'Kế toán'])} {rnd.choice(['có quyền', 'phải', 'không được'])} {rnd.choice(['xác nhận', 'bàn giao', 'kiểm tra'])} {rnd.choice(['hợp đồng', 'bảng lương', 'hồ sơ'])} trong {rnd.randrange(2, 99)} ngày."


def test_fetched_texts():
    inner = json.dumps({"text": "sâu"})
    payload = {"http_status": 200, "final_url": "https://h.example/x", "title": "T", "page": {"lang": "vi", "text": "một"}, "blocks": [{"type": "p", "text": "hai"}], "extract": inner, "text": None}
    assert sorted(r.fetched_texts(json.dumps(payload))) == sorted([(True, "T"), (False, "một"), (False, "hai"), (False, "sâu")])
    assert r.fetched_texts(str({"title": "T", "text": None})) == [(True, "T")]
    assert (False, "cắt cụt") in r.fetched_texts('{"http_status": 200, "title": "T", "text": "cắt cụt')
    assert r.fetched_texts('{"extract": "{\\"text\\": \\"B\\\\u00ea') == [(False, "Bê")]
    assert r.fetched_texts(None) == [] == r.fetched_texts("") == r.fetched_texts("  ")
    assert r.status_and_host(json.dumps(payload)) == (200, "h.example")
    assert r.fetched_texts("[" * 5000) != None  # noqa: E711


@pytest.mark.parametrize("s", RESIDUE)
def test_weak_label_residue(s):
    assert r.weak_label(s, 200) == 1


@pytest.mark.parametrize("s", [*MENTIONS, "Người lao động có quyền."])
def test_weak_label_text(s):
    assert r.weak_label(s, 200) == 0
    assert r.weak_label(s, 500) is None


def rows(spark, seed=1, n=600):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        text = " ".join(prose(rnd) for _ in range(rnd.randrange(2, 6)))
        case = i % 4 == 0
        if case:
            text += "\n" + rnd.choice(RESIDUE)
        elif i % 4 == 1:
            text += " " + rnd.choice(MENTIONS)
        host = rnd.choice(["a.example", "b.example", "c.example"])
        body = text if i % 3 else json.dumps({"http_status": 200, "final_url": f"https://{host}/", "text": text})
        out.append(("content" if i % 3 else "evidence", f"{'case' if case else 'text'}{i}", body, 0.5))
    return spark.createDataFrame(out, "kind string, row_key string, body string, probability double").repartition(3)


def test_cases_of_unseen_rows(spark):
    scored = r.residue_scores(rows(spark)).collect()
    wrong = [x.row_key for x in scored if (x.probability >= r.THRESHOLD) != x.row_key.startswith("case")]
    assert len(scored) == 600 and len(wrong) <= 6


def test_validation_has_a_held_out_host(spark):
    v = r.validation(rows(spark)).collect()
    assert {x.host for x in v if x.held_out} and all(x.n_flagged >= 0.9 * x.n_sentences for x in v if x.label == 1)


def test_validation_counts_every_sentence(spark):
    df = rows(spark)
    expected = Counter((host, label) for x in df.collect() for host, _, _, label in r.told(x.kind, x.body) if label is not None)
    got = r.validation(df, sample_rows=300).collect()
    assert {(x.host, x.label): x.n_sentences for x in got} == expected and sum(expected.values()) > 1800
    assert all(x.n_flagged <= 0.1 * x.n_sentences for x in got if x.label == 0)


def test_sample_is_bounded(spark):
    assert r.labelled(rows(spark), sample_rows=100).count() < r.labelled(rows(spark)).count()


def test_nulls_empty_and_one_class(spark):
    schema = "kind string, row_key string, body string"
    df = spark.createDataFrame([("content", "a", None), ("evidence", "b", ""), ("content", None, "Một câu."), ("evidence", "c", "{broken")], schema)
    assert [x.probability for x in r.residue_scores(df).collect()] == [0.0] * 4
    assert r.residue_scores(spark.createDataFrame([], schema)).count() == 0
    both = df.unionByName(rows(spark, n=80).select("kind", "row_key", "body")).unionByName(spark.createDataFrame([("content", "long", "Người lao động phải bàn giao hồ sơ trong 5 ngày. " * 20_000)], schema))
    got = {x.row_key: x.probability for x in r.residue_scores(both).collect()}
    assert got["a"] == got["b"] == 0.0 and 0 <= got["long"] < 0.5


def test_every_token_of_a_line_is_scored():
    notice = "Vui lòng bật JavaScript"
    for filler in ("45/2019/QH14-", "1.2.3.4.", "a b. "[:3]):
        for n in (12, 20, 400):
            found = [" ".join(r.tokens(s)) for s in r.parts(filler * n + " " + notice)]
            assert any("vui lòng" in f and "bật javascript" in f for f in found)
    assert all(len(r.tokens(s)) <= 60 for s in r.parts("1.2.3." * 400))


def test_features_of_many_sentences_are_those_of_each():
    sentences = ["Số: {{so_hieu}} của", "", "a b a b", "  Điều 5, khoản 12.  ", "x" * 500, "a b a b"]
    titles = [False, True, False, False, True, False]
    featured = r.Features()
    owner, bucket = featured(sentences, titles)
    for i, (s, t) in enumerate(zip(sentences, titles, strict=True)):
        alone = r.Features()([s], [t])[1].tolist()
        assert bucket[owner == i].tolist() == alone == sorted(set(alone))
    # words, pairs, length class and title flag; a repeated pair counts once
    assert len(r.Features()(["a b a b"], [False])[1]) == 2 + 2 + 2 and len(r.Features()([""], [True])[1]) == 2
    assert featured([], [])[0].tolist() == []
