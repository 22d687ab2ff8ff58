import corpus_pipeline
import numpy as np

from graphloom.llm import ann, mixing, neardup, pages, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(spark, *texts):
    """texts: (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in texts], DOCS)


def test_owned_secrets_leave(spark):
    key, example = "Zq9-Xw8_Lk3+Vb7/Nm2=Rt6Yp4Gh1Jd5", "Ab1-Cd2_Ef3+Gh4/Ij5=Kl6Mn7Op8Qr9"
    said = [(1, f"é run {key} now", "a"), (None, f"password=hunter22 and {key}", "b"), (None, None, "a"), (4, "", "a"), (5, "plain", "a")]
    said += [(10 + i, f"see {example}", f"s{i}") for i in range(5)]
    docs = rows(spark, *said)
    got = sorted(((r.doc_id or 0, r.text or "", r.n_chars) for r in corpus_pipeline.redact_secrets(spark, docs, "").collect()))
    want = [(1, "é run [SECRET] now", 18), (0, "[SECRET] and [SECRET]", 21), (0, "", 0), (4, "", 0), (5, "plain", 5)]
    assert got == sorted([*want, *[(10 + i, f"see {example}", len(example) + 4) for i in range(5)]], key=lambda x: x[:2])
    report = {r.doc_id: r.spans for r in secrets.scan_secrets(docs.where("doc_id = 1 OR source = 'b'")).collect()}
    assert report[1] == f"owned:6:{6 + len(key)}"


def test_one_row_of_each_group(spark):
    a, b = "one two three four five six seven", "other words stand here for all to see and read"
    near = "k1 k2 k3 k4 k5 k6 k7 k8"
    texts = [(1, a, "a"), (1, a, "a"), (None, a, "a"), (2, b, "a"), (2, a, "a"), (3, b, "a"), (4, near, "a"), (5, near + " k9", "a"), (None, None, "a"), (None, "", "a")]
    out = corpus_pipeline.keep_one_of_each(spark, rows(spark, *texts), "").collect()
    assert sorted(r.text or "" for r in out) == sorted(["", "", a, b, near])
    for percent in range(50, 101):
        n = next((n for n in range(1, 300) if 100 * n >= percent * (n + 1)), 300)
        assert min(neardup.alone(percent), 299) == n - 1


def texts(spark, *htmls):
    df = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    return [r.text for r in pages.extract_text(df).orderBy("page_id").collect()]


def test_marked_frames_keep_the_text(spark):
    frame = "<html class='cookie'><body class='page with-sidebar'><form><div class='elementor-widget-container'><article><h2 id='social-history'>Head {0}</h2><p class='notice'>Body {0}</p>{1}</article></div></form><div class='sidebar'>side {0}</div></body></html>"
    once = "<div class='alert'>Only here {0}</div>"
    got = texts(spark, *[frame.format(w, once.format(w) if w == "b" else "") for w in "abcd"])
    assert got == ["Head a\n\nBody a", "Head b\n\nBody b\n\nOnly here b", "Head c\n\nBody c", "Head d\n\nBody d"]


def test_template_decides_the_slots(spark):
    words = ["alpha beta gamma delta", "one two three four five", "red green blue and white", "north south east west"]
    framed = "<body><div><article><h1>T {0}</h1><p>{0} is long enough</p><p>Read more on our site</p></article></div></body>"
    assert texts(spark, *[framed.format(w) for w in words]) == [f"T {w}\n\n{w} is long enough\n\nRead more on our site" for w in words]
    teaser = "<body><article>Top story</article><div class='x'><div class='title'>T {0}</div><p>{0} is long enough, and more of it stands here</p></div><p>All rights</p></body>"
    assert texts(spark, *[teaser.format(w) for w in words]) == [f"T {w}\n\n{w} is long enough, and more of it stands here" for w in words]
    assert texts(spark, framed.format("x")) == ["T x\n\nx is long enough\n\nRead more on our site"]


def test_mix_ends_at_the_budget(spark):
    docs = rows(spark, *[(i, "w " * (i % 7), "ab"[i % 2 if i < 40 else 0]) for i in range(200)])
    every = mixing.mix_sources(docs, most=2).collect()
    out = corpus_pipeline.mix(spark, docs, "").collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in every if r.taken)
    assert 0 < len(out) < len(every)


def test_recall_over_many_leaves(spark):
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(40, 1, 16)) + 0.3 * rng.normal(size=(40, 200, 16))).reshape(-1, 16).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 80 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for i in range(0, len(x), 80):
        s = x @ x[i]
        s[i] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & got[i])
        total += 20
    print("recall", hits / total)
    assert hits >= 0.9 * total
