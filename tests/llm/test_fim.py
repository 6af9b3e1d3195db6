import hashlib
import re

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veldt.llm import fim

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def plainly(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by splitting and joining lists."""
    text = text or ""
    x = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k:8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    a, b = sorted(v % (len(units) + 1) for v in h[:2])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    pre, mid, suf = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, None)))
    if h[3] % 100 < 20:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@given(st.binary(max_size=60), st.integers(0, 60), st.integers(0, 60), st.integers(0, 60))
def test_rotation_exchanges_blocks_and_undoes_itself(data, x, y, z):
    a, b, c = sorted(min(v, len(data)) for v in (x, y, z))
    buf = bytearray(data)
    fim.rotate(buf, a, b, c)
    assert bytes(buf) == data[:a] + data[b:c] + data[a:b] + data[c:]
    fim.rotate(buf, a, a + c - b, c)
    assert bytes(buf) == data


@given(st.text("aZ <>PSMé\U0001f600\n", max_size=40), st.integers(0, 40), st.integers(0, 40), st.sampled_from(["plain", "psm", "spm"]))
def test_every_output_gives_its_text_back(text, x, y, form):
    if any(s in text for s in ("<P>", "<S>", "<M>")):
        form = "plain"
    a, b = sorted(len(text[:v].encode()) for v in (x, y))
    out = bytes(fim.exchange(text.encode(), a, b, form))
    assert bytes(fim.rebuild(out, form)) == text.encode()


def test_messy_rows_and_many_ids_match_the_plain_version(spark, messy, messy_rows):
    rows = [(r[0], r[1]) for r in messy_rows]
    extra = [(k, t) for k, t in enumerate(["a<P>b", "x <S", "<M>", "<<P", "S>S>", "café naïve \U0001f600!", "ab12cd  \n\t", "\u0000x"] * 40, 1000)]
    docs = messy.select("doc_id", "text", "row", "n_chars").unionByName(
        spark.createDataFrame(extra, "doc_id long, text string").select("doc_id", "text", F.lit("r").alias("row"), F.lit(0).alias("n_chars")))
    got = fim.restore(fim.fill_in_middle(docs)).collect()
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=key) == \
        sorted(((i, *plainly(i, t)) for i, t in rows + extra), key=key)
    assert sorted((r["doc_id"] or -1, r["restored"]) for r in got) == sorted((i or -1, t or "") for i, t in rows + extra)


def test_shares_are_parameters(spark, messy):
    assert {r["form"] for r in fim.fill_in_middle(messy, plain_percent=100).collect()} == {"plain"}
    assert {r["form"] for r in fim.fill_in_middle(messy, plain_percent=0, spm_percent=100).where("output <> ''").collect()} == {"spm"}


def test_no_rows(empty):
    out = fim.restore(fim.fill_in_middle(empty))
    assert out.count() == 0 and out.columns[-1] == "restored"
