"""Operators that work row by row: language, decontamination, secrets, toxicity."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import random
import re
import time
import unicodedata

import duckdb
import numpy as np
import pytest
import zstandard

from tessera.llm import decontam, langid, queries, secrets, toxicity

from .helpers import AWKWARD, LONG, alnum, crc, documents


def pairs(df):
    return {r["doc_id"]: r for r in df.collect()}


# Language


def test_language_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op1_language(spark, sf).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (crc(r["doc_id"], 4) == 2) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_awkward_rows(spark):
    texts = ["the cat and the dog were there " * 9, "der hund und die katze waren da " * 9] * 6 + AWKWARD
    langs = ["en", "de"] * 6 + [None] * len(AWKWARD)
    docs = documents(spark, texts, langs=langs)
    out = pairs(langid.predict(docs, langid.fit(docs)))
    assert len(out) == len(texts)
    und = {i for i, r in out.items() if r["lang_pred"] == "und"}
    assert und == {i for i, t in enumerate(texts) if not any(unicodedata.category(c)[0] == "L" for c in t or "")}
    assert out[0]["lang_pred"] == "en" and out[1]["lang_pred"] == "de"
    empty = documents(spark, [])
    assert langid.predict(empty, langid.fit(empty)).collect() == []
    assert pairs(langid.predict(docs, langid.fit(empty)))[0]["lang_pred"] == "und"


def test_language_against_brute_force(spark, sf):
    """Every prediction of the query, by compressing again without the operator's code for it."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs)
    assert set(model.dictionaries) == {r["lang"] for r in docs.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op1_language(spark, sf).collect():
        raw = re.sub(r"[\W\d_]+", " ", texts[r["doc_id"]].lower()).encode()
        sizes = {}
        for lang, learned in model.dictionaries.items():
            params = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            tool = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(learned, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
            sizes[lang] = sum(len(tool.compress(raw[i : i + langid.CHUNK_BYTES])) for i in range(0, len(raw), langid.CHUNK_BYTES))
        assert r["lang_pred"] == min(sorted(sizes), key=sizes.get)


def test_language_letters_and_tiny_samples(spark):
    texts = ["½ ² ٣ Ⅷ ①", "ª", "日本", "a", "b", "_ 7"]
    docs = documents(spark, texts, ids=[0, 1, 2, 3, 4, 5], langs=["x", "x", "ja", "a", "b", "none"])
    model = langid.fit(docs)
    assert all(len(d) >= langid.MIN_DICT for d in model.dictionaries.values())
    out = pairs(langid.predict(docs, model))
    assert [out[i]["lang_pred"] == "und" for i in range(6)] == [True, False, False, False, False, True]


def test_language_repeated_and_null_ids(spark):
    docs = documents(spark, ["hello there my friend"] * 3 + ["guten tag mein freund"], ids=[1, 1, None, 4], langs=["en", "en", "en", "de"])
    assert langid.predict(docs, langid.fit(docs)).count() == 4


# Decontamination


def brute_windows(docs, items, window=10):
    tests = {}
    for item, text in items:
        w = alnum(text)
        if w:
            k = min(window, len(w))
            for i in range(len(w) - k + 1):
                tests.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = {}
    for doc, text in docs:
        w, hit, found = alnum(text), set(), set()
        for k in {len(t) for t in tests}:
            for i in range(len(w) - k + 1):
                if (names := tests.get(tuple(w[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    found |= {str(n) for n in names if n is not None}
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination_against_brute_force(spark, block_bytes):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = [(1, item), (2, item.lower()), (30, "short item"), (4, None), (5, ""), (None, "nameless window here"), (30, "short item")]
    texts = [*AWKWARD, f"x {item.upper()} y", "alpha beta gamma, delta epsilon zeta eta theta iota kappa", "alpha beta gamma delta", "a short item and a short, ITEM", "nameless window here", item + " " + item]
    docs, bench = documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    want = brute_windows(list(enumerate(texts)), items)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.scan(docs, bench, block_bytes=block_bytes).collect()}
    assert got == want
    kept = decontam.remove(docs, bench, block_bytes=block_bytes)
    assert kept.schema == docs.schema
    assert {r["doc_id"] for r in kept.collect()} == {i for i, v in want.items() if not v[4]}
    cut = decontam.remove(docs, bench, spans=True, block_bytes=block_bytes)
    assert cut.count() == len(texts)
    assert cut.filter(f"doc_id = {len(AWKWARD)}").first()["text"] == "x  y"
    assert decontam.scan(cut, bench).filter("contaminated").count() == 0


def test_decontamination_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = documents(spark, ["a b c", None])
    assert [r["contaminated"] for r in decontam.scan(docs, none).collect()] == [False, False]
    assert decontam.scan(documents(spark, []), none).collect() == []


def test_decontamination_holds_one_block_at_a_time(spark, monkeypatch):
    """Each block's set meets a plan of one pass only, over rows read back from the shared folder."""
    plans, marked = [], decontam._marker
    items = [(i, f"alpha beta gamma delta number{i}") for i in range(12)]
    docs, bench = documents(spark, [f"x {t} y" for _, t in items] + ["clean"]), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontam, "_marker", lambda sets, first: (plans.append(first), marked(sets, first))[1])
    df = decontam.scan(docs, bench, block_bytes=60)
    assert len(plans) > 3
    assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert df.filter("contaminated").count() == len(items)


@pytest.mark.parametrize("name", ["op2_decontaminate", "op5_topk", "op10_curriculum"])
def test_sql_oracles(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    cur = c.execute(queries.oracle_sql()[name])
    order = [[d[0] for d in cur.description].index(x) for x in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in order) for r in cur.fetchall())


# Secrets


def base_by_hand(text):
    out = []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text or "", re.I | re.A):
        out += [("assign", *m.span())] if len(m[2]) >= 6 else []
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def rsa_like():
    number = lambda n: b"\x02" + bytes([n]) + b"\x11" * n
    body = b"\x02\x01\x00" + b"".join(number(60) for _ in range(2)) + number(3) + b"".join(number(40) for _ in range(5))
    return b"\x30\x82" + len(body).to_bytes(2, "big") + body


def jwt(header, payload, mark="c2lnbmF0dXJl"):
    code = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    return f"{code(header)}.{code(payload)}.{mark}"


KEY = base64.b64encode(rsa_like()).decode()
SSH = base64.b64encode(b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", b"k" * 32))).decode()
TOKEN = jwt({"alg": "HS256", "typ": "JWT"}, {"sub": "1"})


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        (f"see {KEY} end", ["private_key"]),
        ("-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(KEY[i : i + 64] for i in range(0, len(KEY), 64)) + "\n-----END RSA PRIVATE KEY-----", ["private_key"]),
        (f"key {rsa_like().hex().upper()} end", ["private_key", "hex", "hex"]),  # its runs of digits are base spans
        (f"ssh-ed25519 {SSH} me@host", ["public_key"]),
        (f"bearer {TOKEN} ok", ["signed_token"]),
        (jwt({"typ": "JWT"}, {"sub": "1"}), []),
        (jwt({"alg": "HS256"}, {"sub": "1"}, ""), []),
        (jwt({"alg": "none"}, {"sub": "1"}, ""), ["signed_token"]),
        (KEY[:-8], []),
        (base64.b64encode(b"just a sentence that is long enough to look like code but is not").decode(), []),
        ("secret=token:abcdefgh", []),
        ("Secret = 'abcdef' é api_key:\"x1y2z3\" apikey=short", ["assign", "assign"]),
        ("AKIA" + "A" * 15, []),
        ("é😀 AKIA" + "A1" * 8 + " password=" + "0f" * 12, ["access", "assign", "hex"]),
    ],
)
def test_secret_structures(text, kinds):
    base, every = secrets.spans_of(text)
    assert base == base_by_hand(text)
    assert [k for k, _, _ in every] == kinds
    assert set(base) <= set(every)


def ed25519(fill):
    return base64.b64encode(bytes.fromhex("302e020100300506032b657004220420") + bytes([fill]) * 32).decode()


def test_every_key_of_a_run_of_lines():
    keys = [ed25519(i) for i in (1, 2, 3)]
    assert len(keys[0]) == 64
    text = "keys\n" + "\n".join([keys[0], keys[1], "words", SSH, keys[2]]) + "\nend"
    spans = secrets.spans_of(text)[1]
    assert [text[a:b] for _, a, b in spans] == [keys[0], keys[1], SSH, keys[2]]
    assert secrets.masked(text, spans, "*") == "keys\n*\n*\nwords\n*\n*\nend"
    name, blob = lambda x: len(x).to_bytes(4, "big") + x, lambda n: n.to_bytes(4, "big") + b"q" * n
    private = base64.b64encode(secrets.OPENSSH + name(b"none") + name(b"none") + name(b"") + b"\0\0\0\1" + blob(51) + blob(139)).decode()
    lines = "\n".join(private[i : i + 70] for i in range(0, len(private), 70))
    assert not private.endswith("=")
    text = f"{lines}\n{keys[0]}"
    assert [(k, text[a:b]) for k, a, b in secrets.spans_of(text)[1]] == [("private_key", lines), ("private_key", keys[0])]


LINES = {
    "zeros": b"\0" * 57,
    "short lengths": b"\x30\x82\x04" * 19,
    "long lengths": (b"\x30\x84\x00\x7f\xff\xff\x02\x01\x00" * 7)[:57],
    "key heads": (b"\x30\x82\xff\x00\x02\x01\x00" + b"\x02\x01\x07" * 20)[:57],
    "wire names": (b"\0\0\0\x07ssh-rsa\0\0\0\1a\0\0\0\1b" * 4)[:57],
    "private wire": (secrets.OPENSSH + b"\0\0\0\4none" * 4)[:57],
}


@pytest.mark.parametrize("name", [*LINES, "keys"])
def test_five_megabytes_of_code_take_seconds(name):
    line = KEY if name == "keys" else base64.b64encode(LINES[name]).decode()
    text = (line + "\n") * (5_000_000 // len(line))
    began = time.process_time()
    found = secrets.spans_of(text)[1]
    assert time.process_time() - began < 8
    assert len(found) == (5_000_000 // len(line) if name in ("keys", "private wire") else 0)


def test_confirmed_keys_against_all_runs_of_lines():
    rng = random.Random(12)
    pieces = [KEY, SSH, *(ed25519(i) for i in range(3)), base64.b64encode(rsa_like() + b"x").decode(), "words", "A" * 76, KEY[:60]]
    for _ in range(60):
        width = rng.choice([40, 64, 76])
        lines = [p[i : i + width] for p in rng.choices(pieces, k=rng.randint(1, 5)) for i in range(0, len(p), width)]
        text = "\n".join(lines)
        starts = [sum(len(x) + 1 for x in lines[:i]) for i in range(len(lines))]
        want, i = set(), 0
        while i < len(lines):
            for j in range(i + 1, len(lines) + 1):
                data = secrets.decoded("".join(lines[i:j])) if not any("=" in x for x in lines[i : j - 1]) else None
                if data and (kind := secrets.der_kind(data) or secrets.ssh_kind(data)):
                    want.add((kind, starts[i], starts[j - 1] + len(lines[j - 1])))
                    i = j - 1
                    break
            i += 1
        assert set(secrets.confirmed_spans(text, text.encode())) == want, text


def test_escaped_line_breaks_and_indented_code():
    for width in (40, 64):
        parts = [KEY[i : i + width] for i in range(0, len(KEY), width)]
        text = '{"key": "-----BEGIN PRIVATE KEY-----\\n' + "\\n".join(parts) + '\\n-----END PRIVATE KEY-----\\n"}'
        (kind, a, b), = secrets.confirmed_spans(text, text.encode())
        assert kind == "private_key" and text[a:b].startswith(parts[0]) and parts[-1] in text[a:b]
        bare = "\n".join(parts)
        assert secrets.confirmed_spans(bare, bare.encode()) == [("private_key", 0, len(bare))]


@pytest.mark.parametrize("head", ['{ "alg":"HS256"}', '{\n"alg": "HS256"}', ' {"alg":"HS256"}', '{"alg":"HS256"}'])
def test_tokens_with_any_header_form(head):
    code = lambda x: base64.urlsafe_b64encode(x.encode()).decode().rstrip("=")
    token = f"{code(head)}.{code('{ }')}.c2lnbmF0dXJl"
    for text in (token, f"a {token} b", f"an-authorization-value.{token}"):
        assert [text[a:b] for k, a, b in secrets.spans_of(text)[1] if k == "signed_token"] == [token]


@pytest.mark.parametrize(("indent", "width"), [("", 64), ("    ", 64), ("", 32), ("\t", 40), ("  ", 7)])
def test_pem_lines_of_any_form(indent, width):
    code = "\n".join(indent + KEY[i : i + width] for i in range(0, len(KEY), width))
    text = f"{indent}-----BEGIN RSA PRIVATE KEY-----\n{code}\n{indent}-----END RSA PRIVATE KEY-----\n"
    assert [(k, text[a:b]) for k, a, b in secrets.spans_of(text)[1]] == [("private_key", code.strip())]


def test_secrets_query_and_redaction(spark, sf):
    texts = [*AWKWARD, "password=hunter22 x AKIA" + "Z" * 16, "x " + "ab" * 12 + " y", f"a {TOKEN} b"]
    docs = documents(spark, texts)
    for r in secrets.scan(docs).collect():
        base = base_by_hand(texts[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex"))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
    clean = secrets.redact(docs)
    assert clean.schema == docs.schema and clean.count() == len(texts)
    assert clean.filter(f"doc_id = {len(AWKWARD)}").first()["text"] == "[secret] x [secret]"
    assert secrets.scan(clean).filter("spans != ''").count() == 0
    assert {r["doc_id"]: r["text"] for r in clean.filter(f"doc_id < {len(AWKWARD)}").collect()} == dict(enumerate(AWKWARD))
    assert secrets.scan(documents(spark, [])).collect() == []
    rows = {r["doc_id"]: r["spans"] for r in queries.op4_secrets(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert rows[r["doc_id"]] == ",".join(f"{k}:{a}:{b}" for k, a, b in secrets.spans_of(r["text"])[1])


# Toxicity


def test_toxicity_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.1")
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op8_toxicity(spark, sf).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (crc(r["doc_id"], 3) == 1) for r in rows)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    found = sum(p and y for p, y in held)
    assert found / sum(y for _, y in held) > 0.7  # about 300 toxic rows train here
    assert found / max(1, sum(p for p, _ in held)) > 0.85


def test_toxicity_against_plain_arithmetic(spark, sf):
    """Scores of the query again, word by word: mean of the subwords' logits, mean over the text and over its worst window, the link."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    logits = {}

    def word_logit(word):
        if word not in logits:
            raw = np.frombuffer(word.encode(), np.uint8)
            buckets = [b for _, bs in toxicity.subwords(raw, np.array([0]), np.array([len(raw)]), len(model.logits)) for b in bs.tolist()]
            assert len(buckets) == 1 + sum(max(0, len(raw) + 3 - n) for n in toxicity.NGRAMS)
            logits[word] = sum(model.logits[b] for b in buckets) / len(buckets)
        return logits[word]

    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    a, b, c = model.link
    for r in docs.collect():
        words = alnum(r["text"])
        z = [word_logit(w) for i, w in enumerate(words) if not i or words[i - 1] != w]
        mean = sum(z) / len(z) if z else 0.0
        worst = max((sum(z[i : i + toxicity.WINDOW]) / toxicity.WINDOW for i in range(len(z))), default=0.0)
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-(a * mean + b * worst + c))), abs=1e-9)


def test_toxicity_awkward_rows(spark):
    texts = [*AWKWARD, *("you are a horrid fool and a horrid brute" if i % 2 else "we went to the market and bought bread" for i in range(60))]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i + len(AWKWARD), 1, i % 2) for i in range(60)] + [(None, 1, 1), (3, None, None), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    out = pairs(toxicity.score(docs, model))
    assert len(out) == len(texts)
    assert out[len(AWKWARD) + 1]["predicted"] == 1 and out[len(AWKWARD)]["predicted"] == 0
    assert toxicity.score(documents(spark, ["such a horridd foool, horrrid brute"]), model).first()["predicted"] == 1
    kept = toxicity.keep_clean(docs, model)
    assert kept.schema == docs.schema
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if not r["predicted"]}
    assert toxicity.score(documents(spark, []), model).collect() == []
    only = labels.filter("toxic = 0")
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, only)).collect()} == {0.0}
    assert len(LONG) > 1 << 21
