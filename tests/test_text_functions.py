"""Golden rows for the Column functions (redaction, tokenising, parsing)."""

from pyspark.sql import functions as F

from convsearch.functions import parse as P
from convsearch.functions import text as TX
from convsearch.functions.splitter import chunks_of


def one(spark, value, expr, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("x")).first()["x"]


def test_redact_goldens(spark):
    cases = {
        "call (555) 123-4567 now": "call (<PHONE> now",
        "+1 555-123-4567": "+<PHONE>",
        "card 4111-1111-1111-1111": "card <CREDIT_CARD>",
        "ssn 123-45-6789": "ssn <SSN>",
        "mail josé@exámple.com": "mail <EMAIL>",
        "user+tag@x.com": "user+<EMAIL>",
        "": "",
    }
    for src, want in cases.items():
        assert one(spark, src, TX.redact(F.col("t"))) == want, src
    assert one(spark, None, TX.redact(F.col("t"))) is None


def test_tokenize_matches_python_split(spark):
    texts = ["  Hello   World\tfoo\nBar  ", "", "ÉCOLE élève", "a b"]
    for t in texts:
        assert one(spark, t, TX.tokenize(F.col("t"))) == t.lower().split()


def test_reference_phrases(spark):
    got = one(spark, "Please see Section 4.2 and refer to the billing policy. Also oversee section x",
              TX.reference_phrases(F.col("t")))
    assert got == ["see Section 4.2", "refer to the billing policy"]


def test_parse_rating_goldens(spark):
    for text, want in {"0.85": 0.85, "0.85/1.0": 1.0, "1.5": 1.0, "85%": 0.5, "": 0.5, "about 0 or 1": 1.0}.items():
        assert one(spark, text, P.parse_rating(F.col("t"))) == want, text


def test_parse_router_goldens(spark):
    cases = {
        '{"category":"Billing ","confidence":"0.9"}': ("billing", 0.9, False),
        '{"category":"billing"}': ("billing", 0.5, False),
        '{"category":"billing","confidence":null}': ("escalation", 0.5, True),
        "[1]": ("escalation", 0.5, True),
        '{"category":"shipping","confidence":0.8}': ("escalation", 0.8, False),
        'Sure {"category": "returns", "confidence": 0.7} ok': ("returns", 0.7, False),
        '{"category": "billing", "confidence": 1.2.3}': ("billing", 0.5, False),
        "no json here": ("escalation", 0.5, False),
    }
    for text, want in cases.items():
        r = one(spark, text, P.parse_router(F.col("t")))
        assert (r["category"], r["confidence"], r["failed"]) == want, text


def test_route_threshold(spark):
    df = spark.createDataFrame([("billing", 0.64, False), ("billing", 0.65, False), ("returns", 0.9, True)],
                               "category string, confidence double, failed boolean")
    got = [tuple(r) for r in df.select(P.route(F.struct("category", "confidence", "failed")).alias("r"))
           .select("r.*").collect()]
    assert got == [("escalation", 0.64), ("billing", 0.65), ("escalation", 0.5)]


def test_parse_answer(spark):
    r = one(spark, "ANSWER: Refunds take 5 days.\n  CONFIDENCE: 0.8", P.parse_answer(F.col("t")))
    assert (r["answer"], r["rating_text"]) == ("Refunds take 5 days.", "0.8")
    r = one(spark, "  no markers  ", P.parse_answer(F.col("t")))
    assert (r["answer"], r["rating_text"]) == ("no markers", "")


def split_texts(spark, texts, size=512, overlap=64):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.c for r in df.select("i", chunks_of("t", size, overlap).alias("c")).collect()}
    return [got[i] for i in range(len(texts))]


def test_splitter_goldens(spark):
    mixed = ("para one line one\nline two " + "w " * 400 + "\n\n" + "second para " * 60).strip()
    got = split_texts(spark, ["x" * 512, "y" * 600, "   ", "", None, "😀" * 600, mixed])
    assert got[:5] == [["x" * 512], ["y" * 512, "y" * 152], [], [], []]  # 64 characters of overlap
    assert got[5] == ["😀" * 512, "😀" * 152]
    assert got[6] and all(len(c) <= 512 for c in got[6])


def test_splitter_overlap(spark):
    text = " ".join(f"w{i:03d}" for i in range(300))  # 1199 chars, one line
    chunks = split_texts(spark, [text], 100, 20)[0]
    assert all(len(c) <= 100 for c in chunks)
    # consecutive chunks share at most the overlap
    for a, b in zip(chunks, chunks[1:]):
        assert b.split()[0] in a.split()[-5:]


def plain_chunks(text, size, overlap, separators=("\n\n", "\n", " ", "")):
    """The rule, piece by piece over character offsets."""
    for level, sep in enumerate(separators):
        if sep in text:
            break
    later = separators[level + 1:]
    cuts = list(range(len(text))) if not sep else [0]
    at = text.find(sep) if sep else -1
    while at >= 0:
        cuts.append(at)
        at = text.find(sep, at + len(sep))
    cuts = sorted(set(cuts)) + [len(text)]
    out, first, end = [], None, None  # the window is text[first:end]

    def close():
        if first is not None and text[first:end].strip():
            out.append(text[first:end].strip())

    for a, b in zip(cuts, cuts[1:]):
        if b - a >= size:
            close()
            first = None
            out += plain_chunks(text[a:b], size, overlap, later) if later else [text[a:b]]
            continue
        if first is not None and b - first > size:
            close()
            first = min(c for c in cuts if first <= c <= a and a - c <= overlap and (b - c <= size or c == a))
        first, end = (a if first is None else first), b
    close()
    return out


def test_splitter_equals_the_rule(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \n\n😀é ") for _ in range(rng.randint(1, 150))) for _ in range(120)] + ["x" * 70 + " " + "y" * 9 + "\n\n\n" + "z z" * 10, " \n\n a"]
    for size, overlap in ((20, 5), (7, 3), (1, 0), (10, 9), (50, 0)):
        assert split_texts(spark, texts, size, overlap) == [plain_chunks(t, size, overlap) for t in texts]
