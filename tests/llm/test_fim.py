"""Fill-in-the-middle against a plain Python version."""

import hashlib
import re

from rollcall.llm import fim
from rollcall.llm.queries import QUERIES

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(key, text, seed="42"):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    lo, hi = sorted([h[0] % (n + 1), h[1] % (n + 1)])
    prefix, middle, suffix = ("".join(units[a:b]) for a, b in ((0, lo), (lo, hi), (hi, n)))
    if not text or any(s in text for s in fim.SENTINELS) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


ODD = [
    "", None, " ", "\t\n", "a", " a", "a ", "  a  b  ", "ñandú \x0b ça\x0c\r\n", " no space\u0085", "< P> <P", "x <S> y", "<M>",
    "<P", "S> a <", "\0 a \0", "\U0001f600 \U0001f600", "a\xff b\xfe", "word " * 3000, "x" * 100_000, " " * 5000,
]


def test_odd_texts_and_blocks(spark, monkeypatch):
    rows = [(i * 7 + j, t) for j in range(7) for i, t in enumerate(ODD)] + [(None, "no id here"), (3, "same id"), (3, "same id")]
    df = spark.createDataFrame([(k, t, "n", "f") for k, t in rows], "doc_id long, text string, n string, form string")
    for size in (fim.BLOCK_BYTES, 50):
        monkeypatch.setattr(fim, "BLOCK_BYTES", size)
        got = fim.restore(fim.fill_in_middle(df)).collect()
        want = sorted(((k, *brute(k, t), t or "") for k, t in rows), key=repr)
        assert sorted(((r.row.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got), key=repr) == want
        assert {(r.row.n, r.row.form) for r in got} == {("n", "f")}


def test_other_sentinels_and_rates(spark):
    df = spark.createDataFrame([(i, f"one two {i} three <P> four") for i in range(40)], "id long, body string")
    got = fim.fill_in_middle(df, "id", "body", sentinels=("[p]", "[s]", "[m]"), rate=100, suffix_first=0)
    back = fim.restore(got, ("[p]", "[s]", "[m]")).collect()
    assert {r.form for r in back} == {"psm"} and all(r.restored == f"one two {r.row.id} three <P> four" for r in back)
    assert len({r.output for r in back}) == 40


def test_query(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["op11_fill_in_middle"](spark, str(tmp_path)).count() == 0
