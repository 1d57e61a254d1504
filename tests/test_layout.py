from __future__ import annotations

from attestra.operators import layout


def test_windows_of_up_to_seven_tokens_go_on_over_close_lines(spark):
    # Four words in each of three lines; the third lies far below.
    toks = [(1, 1, 4 * n + i, f"w{4 * n + i}", 0.1 * i, t, 0.1 * i + 0.05, t + 0.02) for n, t in enumerate((0.10, 0.14, 0.50)) for i in range(4)]
    df = spark.createDataFrame(toks, "id bigint, page int, ord int, word string, l double, t double, r double, b double")
    got = {(r["ord"], r["k"]): r for r in layout.page_windows(df, "id").collect()}
    expected = {(o, k) for k in range(2, 8) for o in range(12) if o + k <= 8 or o >= 8 and o + k <= 12}
    assert set(got) == expected
    assert got[0, 7]["text"] == "w0 w1 w2 w3 w4 w5 w6" and abs(got[0, 7]["b"] - 0.16) < 1e-9
