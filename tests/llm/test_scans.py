"""Scan noise: lines, broken words, misread characters, and what must stay."""

import pytest

from quern.llm import scans as s
from quern.llm.scans import candidates, counts, distance, number_like, pieces, repaired_texts, repairs, tokens

LINE = "người lao động phải bàn giao hồ sơ trong {} ngày khi có việc làm mới và được trả lương."


def corpus(extra):
    return [("k", f"base{i}", LINE.format(i)) for i in range(60)] + [("k", f"en{i}", "a home-based worker may work at home for 3 days") for i in range(20)] + extra


def run(spark, extra):
    df = spark.createDataFrame([(*x, "y", 1) for x in corpus(extra)], "kind string, row_key string, text string, token string, at int").repartition(3)
    return {(r.row_key, r.what, r.token, r.meant) for r in repairs(df).collect()}


@pytest.mark.parametrize("line,kind", [("- 12 -", "page"), ("— 7 —", "page"), ("Trang 3/10", "page"), ("[tr. 5]", "page"), ("Page 2 of 9", "page"), ("~11~", "page"), ("88", "page"), ("135   KỶ YẾU NGÀNH", "header"), ("TẬP SAN — Số 3 + 4", "header"), ("BẢN TIN/Số 5/Ngày 1-2-2019", "header"), ("Công Báo Vùng, kỳ 8", "header"), ("12/2014/TT-BVL | An toàn | tr. 9", "header")])
def test_noise_lines(line, kind):
    kept, noise = pieces(f"một hai\n{line}\nba bốn")
    assert noise == [(kind, line)] and kept == ["một hai", "ba bốn"]


@pytest.mark.parametrize("line", ["Điều 5.", "bậc 1: 20 giờ", "QUY ĐỊNH RIÊNG", "- phần chung;", "CHƯƠNG II", "Giai đoạn 2019 - 2020", "áp dụng biểu K0-17/B8.", "1. Người lao động"])
def test_lines_that_stay(line):
    assert pieces(f"một hai.\n{line}\nba bốn.")[1] == []


def test_breaks_over_noise_and_blank_lines():
    kept, noise = pieces("Ngư-\n\n- 3 -\n\n    ời lao động")
    assert s.joined(kept) == "Người lao động" and [n[0] for n in noise] == ["page", "break"]
    assert pieces("từ 2019 -\n2020")[1] == [] == pieces("số 12/2014/TT-\nLTB")[1]
    assert pieces("lươ¬\nng")[1] == [("break", "")]


def test_distance_and_numbers():
    assert distance("làrn", "làm") < 1 and distance("tbeo", "theo") < 1 and distance("nguời", "người") < 1 and distance("kh|", "khi") < 1
    assert distance("mèo", "theo") > 1 and distance("bàn", "hồ") > 1
    assert number_like("5O") and number_like("14.702.0o0") and not number_like("50") and not number_like("K0-17") and not number_like("x")
    assert tokens("(Điều 5, 12.000 đồng); “a”") == ["điều", "0", "0", "đồng", "a"]


def test_repairs(spark):
    got = run(spark, [("k", "r1", "người lao động phảl bàn giao hồ sơ trong 5O ngày"), ("k", "r2", "nguời lao động ph-\nải bàn giao"), ("k", "r3", "a home-\nbased worker may work"), ("k", "r4", "người 1ao động\n- 4 -\nphải"), ("k", "r5", "mèo con chạy qua sân nhà"), ("k", "r5", "mèo con chạy qua sân nhà")])
    assert got == {("r1", "word", "phảl", "phải"), ("r1", "word", "5o", "0"), ("r2", "word", "nguời", "người"), ("r2", "break", "ph-ải", None), ("r4", "word", "1ao", "lao"), ("r4", "page", "- 4 -", None)}


def test_rare_right_words_stay(spark):
    assert run(spark, [("k", "r", "nên trả lại hộ chiếu cho họ")]) == set()


def test_texts(spark):
    rows = corpus([("k", "r1", "Nguời lao động ph-\nải bàn\ngiao hồ sơ trong 5O ngày.\n- 7 -\n1. Mới."), ("k", "r2", "a home-\nbased worker"), ("k", "n", None), ("k", "e", ""), ("k", "e", "")])
    got = {r.row_key: r.text for r in repaired_texts(spark.createDataFrame(rows, "kind string, row_key string, text string")).collect()}
    assert got["r1"] == "Người lao động phải bàn giao hồ sơ trong 50 ngày.\n1. Mới."
    assert got["r2"] == "a home-based worker" and got["n"] is None and got["e"] == "" and len(got) == len({r[1] for r in rows})


def test_empty_null_long(spark):
    schema = "kind string, row_key string, text string"
    assert repairs(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([("k", "a", None), ("k", None, "x"), ("k", "b", ""), ("k", "c", "từ " * 100_000), ("k", "d", "z" * 50_000)], schema)
    assert repairs(df).count() == 0


def test_candidates_against_all_pairs(spark):
    words = {"người": 400, "lao": 300, "động": 300, "theo": 200, "làm": 200, "nguời": 3, "tbeo": 2, "làrn": 2, "1ao": 1, "mèo": 4, "đ0ng": 1, "xyz": 1}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {(r.seen, r.meant) for r in candidates(df).collect()}
    brute = {(a, b) for a in words for b in words if a != b and words[b] >= s.RATIO * words[a] and b.isalpha() and distance(a, b) <= s.FARTHEST}
    assert got == brute and ("làrn", "làm") in got
    texts = spark.createDataFrame([("k", "1", "a b a b"), ("k", "2", "a b")], "kind string, row_key string, text string")
    told = counts(texts).collect()
    assert {r.word: r.n for r in told if r.word} == {"a": 3, "b": 3} and sorted(r.n for r in told if r.pair is not None) == [1, 3]


@pytest.mark.parametrize("line", ["Tạp chí Lao động  12", "LABOUR GAZETTE | 7", "Bản Tin | Việc làm | trang 14", "BÁO CÁO — Kỳ 7", "(5)", "14 | Sổ Tay Nhân Sự", " ".join(["Tập San Nghiên Cứu"] * 12) + " — Số 4"])
def test_other_folios(line):
    assert [n[1] for n in pieces(f"một hai\n{line}\nba bốn")[1]] == [line]


@pytest.mark.parametrize("line", ["Giai đoạn 2019 - 2020", "theo Công báo của vùng, số 12", "12   ngày làm việc", "Quyết định 12/2014/TT-BVL", "Điều 12", "bậc 3  400"])
def test_numbers_at_line_ends_that_stay(line):
    assert pieces(f"một hai.\n{line}\nBa bốn.")[1] == []


def test_headers_without_numbers(spark):
    """Lines that no shape knows are headers where they interrupt known sentences in several texts; headings and names are not."""
    cut = "người lao động phải bàn giao\n{}\nhồ sơ trong 5 ngày khi có việc làm mới và được trả lương."
    rows = [("k", f"h{i}", cut.format("BỘ LUẬT LAO ĐỘNG")) for i in range(4)] + [("k", f"g{i}", cut.format("Tạp chí Việc Làm")) for i in range(2)]
    rows += [("k", f"t{i}", "người lao động phải bàn giao.\nQUY ĐỊNH RIÊNG\nngười lao động") for i in range(9)]
    rows += [("k", f"p{i}", "người lao động ở tại\nPhú Yến\nphải bàn giao hồ sơ trong 5 ngày") for i in range(9)]
    got = {(r[0], r[1]) for r in run(spark, rows)}
    assert got == {(f"h{i}", "header") for i in range(4)}
    texts = {r.row_key: r.text for r in repaired_texts(spark.createDataFrame(corpus(rows), "kind string, row_key string, text string")).collect()}
    assert texts["h1"] == "người lao động phải bàn giao hồ sơ trong 5 ngày khi có việc làm mới và được trả lương." and "RIÊNG" in texts["t1"]


def test_long_words_are_repaired(spark):
    """A word of more than forty letters is in the index like any other, and one of 3,000 too."""
    for word, wrong in (("pneumonoultramicroscopicsilicovolcanoconiosisx", "pneumonoultramicr0scopicsilicovolcanoconiosisx"), ("ab" * 1500, "ab" * 700 + "ah" + "ab" * 799)):
        texts = [("k", f"w{i}", f"mắc bệnh {word} khi làm việc") for i in range(25)] + [("k", "x", f"mắc bệnh {wrong} khi làm việc")]
        got = {(r.row_key, r.meant) for r in repairs(spark.createDataFrame(texts, "kind string, row_key string, text string")).collect()}
        assert got == {("x", word)}


def test_deletes():
    brute = lambda w: {s.skeleton(w), *(s.skeleton(w)[:i] + s.skeleton(w)[i + 1 :] for i in range(len(s.skeleton(w))))} - {""}
    words = ["a", "ab", "aab", "lao", "động", "đ0ng", "aaaa", "theo", "tbeo"]
    for a in words:
        assert len(s.deletes(a)) == len(brute(a))
        for b in words:
            assert bool(s.deletes(a) & s.deletes(b)) == bool(brute(a) & brute(b))
