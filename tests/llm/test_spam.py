"""Spam pages on planted rows, and the statistics on edge cases."""

import random

import numpy as np

from quern.llm.spam import FEATURES, LANGUAGES, chi_square, spam, spam_scores, statistics

SUBJECTS = ["Người lao động", "Người sử dụng lao động", "Hội đồng cơ sở", "Tổ chức đại diện", "Kế toán tiền lương"]
VERBS = ["có quyền xác nhận", "phải bàn giao", "không được từ chối", "có thể kiểm tra", "cần báo cáo về"]
THINGS = ["hợp đồng có thời hạn", "bảng chấm công", "thời gian thử việc", "trang bị bảo hộ", "thang bảng lương", "hồ sơ sức khỏe"]
ENDS = ["trong thời hạn {} ngày khi có yêu cầu của tập thể.", "với mức {} phần trăm nếu hai bên không có thỏa thuận khác.", "sau {} tháng kể từ ngày ký ở nơi làm việc."]
KEYS = ["giày mũi sắt", "tuyển dụng gấp", "áo bảo hộ giá rẻ", "luật sư giỏi"]


def corpus(seed=1):
    rnd = random.Random(seed)
    prose = lambda n: " ".join(f"{rnd.choice(SUBJECTS)} {rnd.choice(VERBS)} {rnd.choice(THINGS)} {rnd.choice(ENDS).format(rnd.randrange(9, 99))}" for _ in range(n))
    docs = [(i, prose(rnd.randrange(4, 14)).replace('. ', '.\n' if i % 2 else '. ')) for i in range(400)]
    table = lambda n: "\n".join(f"{i}. {rnd.choice(SUBJECTS)} {rnd.choice(VERBS)} {rnd.choice(THINGS)} {rnd.choice(ENDS).format(i)}" for i in range(1, n))
    docs += [(1000 + i, table(6 + i % 9)) for i in range(80)] + [(500, table(12)), (501, None), (502, ""), (503, "  \n"), (504, "Một câu ngắn.")]
    bad = [", ".join(rnd.choice(KEYS) for _ in range(60)), " ".join("#" + rnd.choice(KEYS).replace(" ", "_") for _ in range(60)), "\n".join(f"[{rnd.choice(KEYS)}](https://a{rnd.randrange(99)}.example/{i})" for i in range(40)), prose(1) + "\n" + ", ".join(rnd.choice(KEYS) for _ in range(80))]
    return docs + [(600 + i, t) for i, t in enumerate(bad)]


def test_planted_pages_are_found_and_no_other(spark):
    df = spark.createDataFrame([(*x, "vi", 3) for x in corpus()], "doc_id long, text string, language string, n_words int").repartition(3)
    got = {r.doc_id for r in spam(df.unionByName(df.where("doc_id BETWEEN 600 AND 700"))).collect()}
    assert got == {600, 601, 602, 603}
    scores = spam_scores(df).collect()
    assert len([r for r in scores if r.distance2 is None]) == 2 and len(scores) == len(corpus()) - 1


def test_short_link_pages_are_found_and_short_notes_are_not(spark):
    """No least length: eleven tags are a tag page, four words and a date are none."""
    docs = corpus() + [(700, " ".join(f"#viec_lam_{i}" for i in range(11))), (701, "(Cập nhật ngày 12/11.)"), (702, "Xem thêm: Điều 5."), (703, "https://a.example/1 https://a.example/2 https://b.example/3 https://b.example/4 https://b.example/5 https://c.example/6")]
    got = {r.doc_id for r in spam(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {600, 601, 602, 603, 700, 703}


def test_language_without_function_words():
    assert [LANGUAGES[k] for k in statistics(["cheap shoes buy now", "giày mũi sắt", "chaussures bon marché", "дешевые ботинки", "billige Schuhe kaufen", "cheap shoes"], [None, "en", "und", "", "de", "fr"])[1]] == ["en", "vi", "fr", "other", "other", "fr"]
    mixed = statistics(["người lao động phải the payroll unit shall extend the plan le salarié est tenu"])[2][0][0]
    assert mixed > statistics(["người lao động phải payroll unit extend plan salarié tenu"])[2][0][0]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spam(df).count() == 0
    assert spam(spark.createDataFrame([(1, None), (2, "")], df.schema)).count() == 0


def test_statistics_of_edge_cases():
    words, language, values = statistics(["", "a", "đi " * 5000, "x" * 100_000, "http://a.b/c http://a.b/c", "ệ"])
    assert values.shape == (6, len(FEATURES)) and np.isfinite(values).all()
    assert words.tolist() == [0, 1, 5000, 1, 2, 1] and len(language) == 6


def test_chi_square():
    assert abs(chi_square(1.96, 7) - 16.01) < 0.2
