"""Nested attachments, page blocks, registered domains and exact quantiles against brute force."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from clueforge.functions import domains
from clueforge.operators.quantiles import exact_quantiles
from clueforge.sources import blocks, multimodal

# --- quantiles


@pytest.mark.parametrize("seed", range(4))
def test_exact_quantiles(spark, seed):
    rng = random.Random(seed)
    draw = [lambda: rng.choice([1.0, 2.0]), lambda: rng.gauss(0, 1), lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300), lambda: 7.5][seed]
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), draw()) for _ in range(900)] + [("a", None), ("empty", None), ("nan", float("nan")), ("one", 3.0), ("ends", float("-inf") if seed == 1 else -1.0)]
    shares = (0.0, 0.25, 0.5, 0.95, 1.0)
    found = {(r.k, r.share): r.quantile for r in exact_quantiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", shares, bins=8).collect()}
    want = {}
    for key in {k for k, _ in rows}:
        values = sorted(v for k, v in rows if k == key and v is not None and not math.isnan(v))
        for s in shares if values else ():
            want[key, s] = values[max(1, math.ceil(s * len(values))) - 1]
    assert found == want


def test_no_values(spark):
    assert exact_quantiles(spark.createDataFrame([], "k string, v double"), "k", "v", (0.5,)).count() == 0


# --- domains


def test_registered_domains(spark):
    denied = ("bad.com", "x.example.org")
    cases = {
        "www.Shop.example.com.": "example.com", "a.b.co.uk": "b.co.uk", "co.uk": None, "com": None, "": None, None: None, "localhost": None, "www.": None, "bad.com": None, "deep.bad.com": None,
        "notbad.com": "notbad.com", "a.x.example.org": None, "y.example.org": "example.org", "city.gov.cn": None, "lab.edu": None, "a..com": None, "host.unknown": "host.unknown", "a.host.unknown": "host.unknown",
    }
    match = domains.domain_matcher(spark, denied=denied)
    df = spark.createDataFrame([(h,) for h in cases], "host string")
    assert {r.host: r.d for r in df.select("host", match(F.col("host")).alias("d")).collect()} == cases
    urls = {"https://User:pw@A.example.com:8080/x?y": "a.example.com", "hxxp://b.example.org#z": "b.example.org", "c.example.net/p": "c.example.net", None: None}
    assert {r.u: r.h for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", domains.host_of(F.col("u")).alias("h")).collect()} == urls


def test_many_rules_cost_no_more_steps(spark):
    rng = random.Random(1)
    denied = {f"d{i}.{rng.choice(['com', 'net'])}" for i in range(10_000)}
    trie = domains.suffix_trie(domains.PUBLIC, denied)
    for i in rng.sample(range(20_000), 300):
        for tld in ("com", "net"):
            host = f"a.d{i}.{tld}"
            assert domains.registered(host, trie) == (None if f"d{i}.{tld}" in denied else f"d{i}.{tld}")
    rows = spark.createDataFrame([("a.s.com", "x", 1), ("b.s.com", "y", 2), ("b.s.com", "y", 2), ("t.com", "x", 1), (None, "x", 3)], "host string, source string, trace_id long")
    assert [tuple(r) for r in domains.shared_domains(rows, domains.domain_matcher(spark)).collect()] == [("s.com", 2, 2, 1)]


# --- attachments


def clean(value):
    return re.sub(r"\s+", " ", value).strip() if isinstance(value, str) else ""


def plain_walk(node, depth=0):
    """(texts, sources, references, scores) by the definition."""
    texts, sources, refs, scores = [], [], [], []
    if depth > 4 or not isinstance(node, dict):
        return texts, sources, refs, scores
    own = [f for f in (multimodal.TEXT if depth == 0 else multimodal.ATTACHED) if clean(node.get(f))]
    texts += [clean(node[f]) for f in own]
    sources += own
    refs += [f for f in multimodal.MEDIA if node.get(f)]
    score = lambda v: None if v is None else (lambda x: x / 100 if x > 1 else x)(float(str(v).rstrip("%")))
    if own and (node.get("ocr_confidence") is not None or any(f in multimodal.RECOGNISED for f in own)):
        scores += [score(node[f]) for f in multimodal.SCORES if node.get(f) is not None]
    for name in multimodal.NESTED:
        inner = node.get(name)
        for item in [inner] if isinstance(inner, dict) else inner if isinstance(inner, list) else []:
            t, s, r, c = plain_walk(item, depth + 1)
            texts += t
            sources += [f"{name}.{x}" for x in s] or [name]
            refs += [f"{name}.{x}" for x in r] or [name]
            scores += c
    return texts, sources, refs, scores


def test_nested_attachments(spark):
    rng = random.Random(4)

    def node(depth):
        out = {}
        for f in rng.sample([*multimodal.TEXT, "description"], rng.randrange(3)):
            out[f] = rng.choice(["one  two", " ", "", "é\n x", "z"])
        if rng.random() < 0.3:
            out[rng.choice(multimodal.MEDIA)] = rng.choice(["u", ""])
        if rng.random() < 0.4:
            out[rng.choice(multimodal.SCORES)] = rng.choice([0.5, 1, 80, "90%", "0.25"])
        for name in rng.sample(multimodal.NESTED, rng.randrange(3) if depth < 6 else 0):
            out[name] = node(depth + 1) if rng.random() < 0.3 else rng.choice(["text", 5, [], [node(depth + 1) for _ in range(rng.randrange(1, 3))]])
        return out

    records = [node(0) for _ in range(60)]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(100, None), (101, "{broken"), (102, "[1]"), (103, "{}")]
    found = {r.id: r for r in multimodal.folded(spark.createDataFrame(rows, "id long, json string")).collect()}
    assert set(found) == {i for i, _ in rows}
    for i, record in enumerate(records):
        texts, sources, refs, scores = plain_walk(record)
        got = found[i]
        assert got.content_text == " ".join(texts) and got.sources == sorted(set(sources)) and got.references == sorted(set(refs))
        assert got.confidence == (round(sum(scores) / len(scores), 4) if scores else None)
        pictured, primary = any(re.search(multimodal.PICTURED, s) for s in sources), any(s in multimodal.PRIMARY for s in sources)
        assert got.modality == ("mixed" if (pictured or refs) and primary else "image_text" if pictured else "image_reference" if refs else "text")
    assert all((found[i].content_text, found[i].sources, found[i].modality) == ("", [], "text") for i in (100, 101, 102, 103))


# --- blocks


def grown(rng, depth, out, parent):
    """A page's source, and its blocks as they should come out."""
    tag = rng.choice(["div", "section", "article", "ul"] if depth < 4 else ["p", "h2"])
    place = len(out)
    out.append([parent, tag, f"k{place}" if rng.random() < 0.5 else "", []])
    html = f'<{tag} class=" {out[place][2]}  ">' if out[place][2] else f"<{tag}>"
    inside = "li" if tag == "ul" else None
    for _ in range(rng.randrange(4)):
        if inside or depth >= 4 or rng.random() < 0.5:
            word = rng.choice(["a &amp; b", "x<br>y", "<b>bold</b> z", "<script>no()</script>", "<!-- no -->w"])
            shown = {"a &amp; b": "a & b", "x<br>y": "xy", "<b>bold</b> z": "bold z", "<script>no()</script>": "", "<!-- no -->w": "w"}[word]
            if inside:
                out.append([place, "li", "", [shown]])
                html += f"<li>{word}" + rng.choice(["</li>", ""])  # the end of an item may be left out
            else:
                out[place][3].append(shown)
                html += f" {word} "
                out[place][3].append(" ")
        else:
            html += grown(rng, depth + 1, out, place)
    return html + f"</{tag}>"


def test_page_blocks(spark):
    rng = random.Random(8)
    pages, want = [(100, None), (101, ""), (102, "only text"), (103, "<p>one<p>two<div>three</div></p>"), (104, "<table><tr><td>a<td>b<tr><td>c</table>")], {}
    for i in range(40):
        out = []
        pages.append((i, "<!DOCTYPE html>" + grown(rng, 0, out, None)))
        want[i] = [(place, parent, tag, cls, " ".join(" ".join(pieces).split())) for place, (parent, tag, cls, pieces) in enumerate(out)]
    df = spark.createDataFrame(pages, "page_id long, html string").repartition(3)
    got = {}
    for r in blocks.blocks_of(df).collect():
        got.setdefault(int(r.page_id), []).append((r.block, r.parent, r.tag, r.classes, r.text))
        assert r.words == len(r.text.split())
    assert {i: sorted(v) for i, v in got.items() if i < 100} == want
    assert [(b[2], b[4]) for b in sorted(got[103])] == [("p", "one"), ("p", "two"), ("div", "three")] and 102 not in got
    assert [(b[2], b[4]) for b in sorted(got[104])] == [("table", ""), ("tr", ""), ("td", "a"), ("td", "b"), ("tr", ""), ("td", "c")]
    df.createOrReplaceTempView("some_pages")
    assert spark.sql("SELECT count(*) FROM page_blocks(TABLE(SELECT page_id, html FROM some_pages WHERE page_id = 103))").collect()[0][0] == 3


def test_public_channel_query_is_the_blocks_of_the_pages(spark, sf):
    from clueforge import registry

    want = [(str(p.page_id), *b) for p in spark.read.parquet(f"{sf}/pages.parquet").collect() for b in blocks.page_blocks(p.html) if b[5]]
    got = [(r.page_id, r.block, r.parent, r.depth, r.tag, r.text) for r in registry.queries()["src_public_channel"](spark, sf).collect()]
    assert sorted(got, key=repr) == sorted([(w[0], w[1], w[2], w[3], w[4], w[6]) for w in want], key=repr)
