"""Token counts, secrets, contamination, web pages and tool calls against plain re-implementations."""

import html as entities
import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netweave.llm import chat, decontaminate, html, secrets, tokens
from netweave.llm.base import slices, text_buffers

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, spans string, digest int"


def documents(spark, texts, first=0):
    """Rows with clashing extra columns; the last row repeats the first."""
    rows = [(first + i, t, "en", "s", len(t or ""), "x", "y", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:1], DOCS)


AWKWARD = [
    None, "", " ", "\t\n\r", "one", "It's  they'll 12345 a1b2", "<|endoftext|> in <|startoftext|>x", "éé ́x ẛ̣",
    "あいう" * 40, "x" * 500, "1" * 300, "\U0001f600" * 60, "a b c\u0085d\x1ce", "ΣΣ İI",
    "word " * 300, "\n".join(["line of words, with 12 numbers"] * 30),
]


@pytest.fixture(scope="module")
def coder():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.word_vocabulary())


# --- tokens ----------------------------------------------------------------------------

@pytest.mark.parametrize("chunk, overlap", [(tokens.CHUNK, tokens.OVERLAP), (40, 8), (7, 2)])
def test_token_counts_match_library(spark, coder, chunk, overlap):
    docs = documents(spark, AWKWARD)
    got = tokens.token_counts(docs, limit=100, chunk=chunk, overlap=overlap).collect()
    assert len(got) == len(AWKWARD) + 1
    for r in got:
        text = AWKWARD[r["doc_id"]] or ""
        n = len(coder.encode(text, add_special_tokens=False))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 100), text[:30]


def test_token_counts_of_empty_table(spark):
    got = tokens.token_counts(spark.createDataFrame([], DOCS))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and got.count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aZé́Σ '1!\n\t\r <|>あ", max_size=60), max_size=4))
def test_words_add_up(texts):
    path = tokens.word_vocabulary()
    want = [len(tokens.tokenizer(path)[0].encode(t, add_special_tokens=False)) for t in texts]
    assert tokens.count_words(texts, path) == want


def test_boundaries_are_word_starts():
    n, found = tokens.boundaries("ab  cd ef gh", 100, 100, 200, tokens.word_vocabulary())
    assert [p for p, _ in found] == [104, 110] and n >= 4


# --- secrets ---------------------------------------------------------------------------

SECRETS = [
    None, "", "password=abcdefgh", "PassWord : 'abc", "API_KEY=\"ABCDEFGH/=\" token=short apikey: 12345678",
    "AKIA" + "A" * 12 + " AKIAB", "x" + "0f" * 16 + "g" + "ab" * 15, "secret=" + "a" * 40, "é\U0001f600 token=é secret:  0123456789abcdef",
    "token=secret=abcdefgh token: password = hunter2hunter", "ſecret=abcdefgh toKen=abcdefgh",
    "-----BEGIN RSA PRIVATE KEY-----", "gho_" + "a1" * 18, "xoxb-1234567890-abc", "lorem " * 50 + "passwd:abcdefghi",
]


def plain_scan(text, rules):
    found = []
    for k, r in enumerate(rules):
        flags = re.ASCII | (re.IGNORECASE if r.any_case else 0)
        found += [(m.start(), k, m.end()) for m in re.finditer(r.pattern, text, flags) if len(m.group(r.group)) >= r.least]
    return [(s, e, rules[k].kind) for s, k, e in sorted(found)]


def test_secret_spans_match_plain_search(spark):
    rules = secrets.BASE + secrets.EXTRA
    got = secrets.secret_spans(documents(spark, SECRETS)).collect()
    assert len(got) == len(SECRETS) + 1
    for r in got:
        want = plain_scan(SECRETS[r["doc_id"]] or "", rules)
        assert [(s["start"], s["end"], s["kind"]) for s in r["spans"]] == want
    assert secrets.secret_spans(spark.createDataFrame([], DOCS)).count() == 0


def test_redaction(spark):
    got = {r["doc_id"]: r for r in secrets.redact_secrets(documents(spark, SECRETS)).collect()}
    assert got[0]["text"] is None and got[0]["n_chars"] == 0
    assert got[2]["text"] == "<assign>" and got[2]["n_chars"] == 8
    assert got[5]["text"] == "<access> AKIAB"
    assert got[7]["text"] == "<assign>"  # the digits inside are part of it
    assert got[1]["n_tokens"] == "x" and got[3]["text"] == SECRETS[3]


@pytest.mark.parametrize("pattern", [r.pattern for r in secrets.BASE + secrets.EXTRA] + [
    "ab?cde+f", "(abc|xyz)+", "a{3}b", "[ab]cd[ef]", "(?:foo)?bar", "x(abc){2,}y", "[^a]bcd", "^abc$", "a.cdef"])
def test_trigram_query_is_necessary(pattern):
    query = secrets.trigram_query(pattern)

    def holds(q, text):
        if q is True:
            return True
        if isinstance(q, bytes):
            return q in text
        return (all if q[0] == "and" else any)(holds(p, text) for p in q[1])

    @settings(max_examples=30, deadline=None)
    @given(st.from_regex(re.compile(pattern, re.ASCII)))
    def check(text):
        assert holds(query, text.lower().encode())

    check()


def test_trigram_queries():
    assert secrets.trigram_query("AKIA[A-Z]+") == ("and", (b"aki", b"kia"))
    assert secrets.trigram_query("[0-9a-f]+") is True
    assert secrets.trigram_query("foo|ba") is True


# --- contamination -----------------------------------------------------------------------

def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_contamination(text, items, size):
    words, hit, met = plain_words(text), set(), set()
    for item, body in items:
        w = plain_words(body)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            window = w[i:i + size]
            for j in range(len(words) - len(window) + 1):
                if words[j:j + len(window)] == window:
                    hit |= set(range(j, j + len(window)))
                    met |= {str(item)} if item is not None else set()
    return len(words), sorted(hit), sorted(met)


ITEMS = [(1, "The quick brown fox, jumps over"), (2, "lazy dog"), (10, "quick brown fox jumps"), (3, None), (4, "..."),
         (None, "nameless one"), (2, "LAZY dog sleeps été É"), (1, "The quick brown fox, jumps over")]
SCANNED = [None, "", "the QUICK brown-fox jumps over a lazy dog", "quick brown", "Lazy dog lazy dog sleeps été É",
           "nameless one here", "été lazy é dog", "x " * 400 + "brown fox jumps over the quick brown fox jumps"]


@pytest.mark.parametrize("shard_bytes", [decontaminate.SHARD_BYTES, 60])
def test_contamination_matches_plain_search(spark, shard_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contamination(documents(spark, SCANNED), items, size=3, shard_bytes=shard_bytes).collect()
    assert len(got) == len(SCANNED) + 1
    for r in got:
        text = SCANNED[r["doc_id"]]
        n, hit, met = plain_contamination(text, ITEMS, 3)
        assert r["n_words"] == n and r["items"] == met
        assert sorted(k for h in r["hits"] for k in range(h["first"], h["last"] + 1)) == hit
        for h in r["hits"]:
            assert plain_words(text[h["start"]:h["end"]]) == plain_words(text)[h["first"]:h["last"] + 1]


def test_contamination_of_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(documents(spark, SCANNED), items).collect()
    assert len(got) == len(SCANNED) + 1 and not any(r["hits"] or r["items"] for r in got)
    some = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contamination(spark.createDataFrame([], DOCS), some).count() == 0


# --- web pages ---------------------------------------------------------------------------

PAGES = [
    ("http://a.example/1", "<html><body><nav><a href=x>Menu here</a></nav><div class=ad>Buy</div><article><h1>T &amp; U</h1>"
     "<p>One <b>two</b>\n three.<br>four<p>five</article><footer>&copy; end</footer></body></html>", "T & U One two three. four five"),
    ("http://a.example/2", "<html><body><div class='content-12'><p>Only body text</p><div class=comments>I like it</div></div></body></html>",
     "Only body text"),
    ("http://b.example/1", "<body><div id=main><p>Long text of the page</p><script>var x='</p>';</script><form><input value=1>Send</form>"
     "<aside>Side</aside><p>and more&nbsp;text</p></div><div><a href=y>link one</a> <a href=z>link two</a></div></body>",
     "Long text of the page and more text"),
    ("http://b.example/2", "<body><div id=main><p>Cut off in the middle &am", "Cut off in the middle &am"),
    (None, None, ""), ("", "", ""), ("no url", "plain text &lt;b&gt;", "plain text <b>"),
    ("http://c.example/", "<article>a<!-- no > --><style>p{}</style><textarea>t</textarea>b</article", "ab"),
    ("http://d.example/", "<article><header><h1>Head</h1></header><p title=\"a>b\">x</p></article><header>site</header>", "Head x"),
]


def test_pages(spark):
    rows = [(i, u, h, "text") for i, (u, h, _) in enumerate(PAGES)]
    pages = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string, text string")
    for hosts in (100, 0):
        got = html.extract_pages(pages, broadcast_hosts=hosts).collect()
        assert len(got) == len(PAGES) + 1
        for r in got:
            assert (r["text"], r["n_chars"], r["url"]) == (PAGES[r["page_id"]][2], len(PAGES[r["page_id"]][2]), PAGES[r["page_id"]][0])
    assert html.extract_pages(pages.limit(0)).count() == 0


def test_host_votes_decide(spark):
    """A page whose largest part is not the host's article is read like the others."""
    body = "<body><div class=story><p>{}</p></div><div class=box><p>{}</p></div></body>"
    rows = [(i, f"http://h.example/{i}", body.format("story text " * 200, "x")) for i in range(8)]
    rows.append((8, "http://h.example/8", body.format("short story", "boxed text " * 100)))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract_pages(pages).collect()}
    assert got[8] == "short story"


def test_hosts(spark):
    urls = ["https://User@WWW.Ex.org:80/a?b", "//ex.org/x", "ftp://m.ex.org#f", "nothing", None, "http:///x"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(html.host_of(F.col("url"))).collect()] == ["ex.org", "ex.org", "m.ex.org", "", "", ""]


def test_article_text_of_given_pages(spark, sf):
    """The given pages hold one article each; its text, found by a plain expression, comes back whole."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {}
    for r in pages.collect():
        m = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.DOTALL)
        body = re.sub(r"<[^>]*(>|\Z)", " ", m[1] if m else "")
        want[r["page_id"]] = " ".join(entities.unescape(body).split())
    for r in html.extract_pages(pages).collect():
        assert r["text"] == want[r["page_id"]]


def read(source):
    return html.main_text(html.read_page(source), [])


def test_a_host_path_does_not_cost_an_article(spark):
    """A page with a short box on its host's path and its article elsewhere gives the article."""
    body = "<body><div class=story><p>{}</p></div></body>"
    rows = [(i, f"http://h.example/{i}", body.format("story text " * 200)) for i in range(8)]
    rows.append((8, "http://h.example/8", f"<body><div class=story>Short box</div><article><p>{'whole article ' * 50}</p></article></body>"))
    rows.append((9, "http://h.example/9", f"<body><div class=story>{'long story ' * 50}</div><article>Teaser</article></body>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract_pages(pages).collect()}
    assert got[8] == ("whole article " * 50).strip() and got[9] == ("long story " * 50).strip()
    assert got[0] == ("story text " * 200).strip()


@pytest.mark.parametrize("name", ["comment-list", "user-comments", "ad-slot", "cookie-banner", "article_comments", "adSlot-2", "userComments",
                                  "related-posts", "newsletter-box", "site-notice", "ads-top"])
@pytest.mark.parametrize("place", ["class", "id"])
def test_compound_names_mark_parts_aside(name, place):
    part = f"<div {place}='{name}'><p>Not the story, though it is long</p></div>"
    assert read(f"<body><article><p>The story</p>{part}<p>goes on</p></article></body>") == "The story goes on"
    assert read(f"<body>{part}<div class=text><p>The story</p></div>{part}</body>") == "The story"
    # One that holds the article does not lose it.
    assert read(f"<body><div {place}='{name}'><article>The story</article></div></body>") == "The story"
    assert read(f"<body><div {place}='{name}'><p>The only text</p></div></body>") == "The only text"


@pytest.mark.parametrize("name", ["has-sidebar", "no-comments", "with-ads", "comments-open", "comments-closed", "downloads", "shared", "adventure"])
def test_names_that_only_speak_of_asides(name):
    assert read(f"<body><div class='{name}'><p>The story</p></div><div class=ad>Buy</div></body>") == "The story"


def test_title_and_lead_in_elements_of_their_own():
    body = "<body><div class=top><a href=x>Home</a></div><div id=content>{}</div><div class=ad>Buy</div></body>"
    parts = f"<div class=title>Title</div><div class=lead>Lead</div><div class=body><p>{'long text ' * 100}</p></div>"
    assert read(body.format(parts)) == "Title Lead " + ("long text " * 100).strip()
    assert read(body.format(parts + "<div class=share-bar>Share</div><div><a href=y>More stories</a></div>")).startswith("Title Lead long")
    assert "Share" not in read(body.format(parts + "<div class=share-bar>Share</div>"))


def test_article_of_links():
    page = "<body><nav><a href=x>Menu</a></nav><div><a href=y>Other</a></div><article><h1><a href=a>One</a></h1><a href=b>Two</a></article></body>"
    assert read(page) == "One Two"
    assert read("<body><div><a href=y>Other</a></div></body>") == ""


@pytest.mark.parametrize("n", [200, 300, 5000])
def test_closing_tags_at_any_depth(n):
    """An article after a long menu comes back whatever the menu's length, and items close their siblings."""
    story = "<article><p>The story itself</p></article>"
    for item in ("<li class=x>item", "<p class=x>item", "<tr class=x><td class=y>cell", "<i class=x>word"):
        assert read(f"<body><nav>{item * n}</nav>{story}</body>") == "The story itself"
    assert read("<ul>" + "<li class=ad>Buy<li class=x>keep this" * n + "</ul>") == " ".join(["keep this"] * n)
    assert read("<ul><li class=ad>Buy<ul><li>now</li></ul>more</li><li>kept</ul>") == "kept"
    assert read("<p class=ad>Buy<div>kept</div>") == "kept"
    assert read("<b><div>one</b> two</div>") == "one two"


@pytest.mark.parametrize("outer", ["article", "main", "div class=page", "section"])
def test_title_and_lead_beside_a_long_body(spark, outer):
    body = f"<body><div class=top><a href=x>Home</a></div><{outer}><h1>Title</h1><p>lead</p>{{}}</{outer.split()[0]}></body>"
    long = "long text " * 300
    inner = [f"<div class=body>{long}</div>", "<div class=body>short</div>", f"<blockquote>{long}</blockquote>",
             f"<table><tr><td>{long}</td></tr></table>", f"<details>{long}</details>"]
    wants = ["Title lead " + " ".join(re.sub("<[^>]*>", " ", x).split()) for x in inner]
    assert [read(body.format(x)) for x in inner] == wants
    rows = [(i, f"http://h{i if i > 1 else 0}.example/", body.format(x)) for i, x in enumerate(inner)]
    got = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == dict(enumerate(wants))


@pytest.mark.parametrize("outer", [
    "div class='content has-sidebar'", "main class='no-sidebar'", "main class=comments", "article class='post comments-open'",
    "article id=related", "div id=social", "div class=notice"])
def test_article_in_a_part_with_an_aside_class(outer):
    tag = outer.split()[0]
    page = f"<body><nav>Menu</nav><div><a href=x>link</a></div><{outer}><p>The story</p></{tag}><div class='ad-12'>Buy</div></body>"
    if outer.split()[-1] not in ("id=social", "class=notice"):
        assert read(page) == "The story"
    assert "The story" in read(page) and "Menu" not in read(page)
    inner = f"<body><div class='social wide'><ul class=menu><li>Share</ul><{outer}><p>The story</p></{tag}></div></body>"
    if tag in ("main", "article"):
        assert read(inner) == "The story"


def test_parts_with_an_aside_class_stay_out():
    assert read("<body><article>Story</article><div class=comments><article>I like it</article></div></body>") == "Story"
    assert read("<body><article>Story<div id=share>Share</div><aside><main>no</main></aside></article></body>") == "Story"
    assert read("<body><article>Story</article><div role=navigation>Go</div><div class='x sidebar_2'>Buy</div></body>") == "Story"
    assert read("<div class=social><article>Story<div class=comments><article>I like it</article></div></article></div>") == "Story"
    # A page that ends before its article has none.
    assert read("<body><nav>Menu</nav><div class=ad>Buy</div>") == read("<body><nav>Menu</nav><div class=ad>Bu") == ""


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/!-\"'= abpdiv&;\n", max_size=80))
def test_any_text_is_read(source):
    page = html.read_page(source)
    assert len(page.paths) == len(page.parents)
    html.main_text(page, ["/div"])


# --- slices ------------------------------------------------------------------------------

def test_slices_cover_batches():
    import pyarrow as pa

    texts = ["a" * n for n in (0, 5, 0, 30, 1, 1, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["zz", *texts, "zz"])], names=["k", "t"]).slice(1, 7)
    parts = list(slices(batch, 6))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts
    raw, at = text_buffers(parts[-1].column(1))
    assert len(at) == parts[-1].num_rows + 1 and list(slices(batch.slice(0, 0))) == []


# --- tool calls ----------------------------------------------------------------------------

SCHEMAS = {"add": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {
    "a": {"type": "number", "minimum": 0}, "b": {"type": ["integer", "null"]}, "c": {"type": "array", "items": {"enum": ["x", 1]}}}}}
CALLS = "conv long, turn long, call_id string, name string, arguments string, json int, level string"
RESULTS = "conv long, turn long, call_id string, content string, status string"


def ref(*ids):
    return json.dumps({"a": 1, "c": [{"$ref": i} for i in ids]})


def test_tool_calls(spark):
    calls = spark.createDataFrame([(*r, 0, "z") for r in [
        (1, 1, "p", "add", '{"b": 2.0, "a": 1}'), (1, 3, "q", "add", ref("p")), (1, 3, "q", "add", ref("p")),
        (2, 1, "a", "add", ref("b")), (2, 2, "b", "add", ref("c", "gone")), (2, 3, "c", "add", '{"a": -1, "z": 0}'),
        (3, 1, "u", "add", ref("v")), (3, 2, "v", "add", ref("u")), (3, 3, "w", "none", None), (3, 4, "s", "add", ref("s")),
        (4, 1, "p", "add", "{broken"), (4, 2, "n", "add", '{"a": NaN}'), (None, 1, "x", "add", "{}"), (4, 9, None, "add", "{}"),
    ]], CALLS)
    results = spark.createDataFrame([(*r, "s") for r in [
        (1, 2, "p", "é\"\n"), (1, 4, "p", "later"), (2, 5, "c", None), (9, 1, "p", "alone"), (None, 1, "p", "none"), (1, 1, None, "n"),
    ]], RESULTS)
    got = {(r["conv"], r["call_id"]): r for r in chat.link_tool_calls(calls, results, SCHEMAS).collect()}
    assert len(got) == 12
    one = got[1, "p"]
    assert (one["status"], one["position"], one["level"], one["valid"], one["n_results"]) == ("linked", 1, 0, True, 2)
    assert one["json"] == '{"arguments":{"a":1,"b":2},"id":"p","name":"add","result":"é\\"\\n","status":"linked"}'
    assert (got[1, "q"]["position"], got[1, "q"]["n_calls"], got[1, "q"]["status"]) == (2, 2, "no_result")
    assert [got[2, c]["position"] for c in "cba"] == [1, 2, 3] and [got[2, c]["level"] for c in "cba"] == [0, 1, 2]
    assert got[2, "c"]["errors"] == "$.a: below minimum; $.z: unknown" and not got[2, "c"]["valid"]
    # A circle has no order, so its calls come last, by turn.
    assert [got[3, c]["level"] for c in "uvws"] == [None, None, 0, None]
    assert [got[3, c]["position"] for c in "wuvs"] == [1, 2, 3, 4]
    assert got[3, "w"]["errors"] == "$: unknown tool"
    assert got[4, "p"]["errors"] == got[4, "n"]["errors"] == "$: not JSON"
    assert (got[9, "p"]["status"], got[9, "p"]["position"], got[9, "p"]["valid"]) == ("no_call", None, False)


def test_call_without_a_turn_follows_what_it_refers_to(spark):
    rows = [(5, None, "n", "add", ref("p"), 0, ""), (5, 1, "p", "add", "{}", 0, "")]
    got = chat.link_tool_calls(spark.createDataFrame(rows, CALLS), spark.createDataFrame([], RESULTS), SCHEMAS).collect()
    assert {r["call_id"]: (r["level"], r["position"]) for r in got} == {"p": (0, 1), "n": (1, 2)}


def test_every_turn_reaches_the_calls_whole(spark):
    """Long assistant texts, system turns and opening user turns all stand in the JSON."""
    from netweave.llm.queries import TOOLS, conversation_turns

    long = "words of an answer, " * 90
    talk = [(1, 0, "system", "be brief"), (1, 1, "user", "first question"), (1, 2, "assistant", long + "a"), (1, 3, "user", "thanks"),
            (2, 0, "user", "opening"), (2, 1, "assistant", long + "bb"), (3, 0, None, "no role")]
    calls, results = conversation_turns(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string"))
    lines = [json.loads(r["json"]) for r in chat.link_tool_calls(calls, results, TOOLS).collect()]
    texts = [x for v in lines for x in (v["result"], (v["arguments"] or {}).get("query")) if x is not None]
    assert sorted(texts) == sorted(t for *_, t in talk)


def test_tool_calls_of_empty_tables(spark):
    got = chat.link_tool_calls(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), SCHEMAS)
    assert got.count() == 0 and got.columns[:3] == ["conv", "call_id", "turn"]


def test_levels_of_random_references(spark):
    """Longest chains below each call, circles and what waits for them left out."""
    import random

    rng = random.Random(3)
    rows, needs = [], {}
    for conv in range(6):
        ids = [f"k{i}" for i in range(25)]
        for i, c in enumerate(ids):
            later = ids[i + 1:] if conv < 4 else ids
            refs = rng.sample(later, min(len(later), rng.choice((0, 1, 1, 2))))
            refs = [ids[i + 1]] if conv == 0 and i < 24 else refs
            needs[conv, c] = {(conv, r) for r in refs}
            rows.append((conv, i, c, "add", ref(*refs), 0, ""))
    level = {}
    for _ in range(200):
        level.update({c: max([level[r] + 1 for r in refs], default=0) for c, refs in needs.items()
                      if all(r in level for r in refs)})
    got = chat.link_tool_calls(spark.createDataFrame(rows, CALLS), spark.createDataFrame([], RESULTS), SCHEMAS).collect()
    assert len(got) == len(rows) and {(r["conv"], r["call_id"]): r["level"] for r in got} == {c: level.get(c) for c in needs}
    place = {(r["conv"], r["call_id"]): r["position"] for r in got}
    assert all(place[r] < place[c] for c, refs in needs.items() if c in level for r in refs)


def test_many_calls_of_one_conversation(spark):
    """Positions run through stretches of turns and ties."""
    rows = [(7, t // 2, f"c{t:05d}", "add", "{}", 0, "") for t in range(1500)]
    got = chat.link_tool_calls(spark.createDataFrame(rows, CALLS), spark.createDataFrame([], RESULTS), SCHEMAS).collect()
    assert sorted((r["turn"], r["call_id"], r["position"]) for r in got) == [(t // 2, f"c{t:05d}", t + 1) for t in range(1500)]


def test_schema_checks():
    assert chat.violations({"a": 1.5, "b": None, "c": ["x", 1]}, SCHEMAS["add"]) == []
    assert chat.violations({"a": True, "b": 1.5, "c": ["y"]}, SCHEMAS["add"]) == ["$.a: not number", "$.b: not integer or null", "$.c[0]: not in enum"]
    assert chat.violations([], {"type": "object"}) == ["$: not object"]
    assert chat.violations("abc", {"minLength": 4, "pattern": "^b"}) == ["$: too short", "$: no match"]
    assert chat.canonical({"b": [1.0, 2.5], "a": "é"}) == '{"a":"é","b":[1,2.5]}'


def test_counts_of_words_do_not_depend_on_what_is_remembered(monkeypatch):
    """Plain and other white space, long and repeated words, and a memory that is too small for one call."""
    from netweave.llm import tokens

    path = tokens.word_vocabulary()
    coder = tokens.tokenizer(path)[0]
    texts = ["", " \t\r\n", "one\ttwo\r\none  three", "a b\x0bc " + "long" * 30 + " " + "long" * 30, "three two one café <|endoftext|>"]
    want = [len(coder.encode(t, add_special_tokens=False)) for t in texts]
    for most in (300_000, 2, 0):
        monkeypatch.setattr(tokens, "MEMO_WORDS", most)
        for _ in range(2):
            assert tokens.count_words(texts, path) == want
            assert all(len(w) <= tokens.MEMO_CHARS for w in tokens.tokenizer(path)[1])
    assert tokens.count_words([], path) == []
