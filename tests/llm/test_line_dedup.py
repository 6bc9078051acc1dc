import random

from panelwright.llm.line_dedup import MIN_WORDS, dedup_lines, repeated_lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diag, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (x != y))
    return row[-1]


def alike(a, b):
    if a == b:
        return True
    return min(len(a), len(b)) >= MIN_WORDS and abs(len(a) - len(b)) <= 1 and distance(a, b) <= 1


def brute(docs):
    seen, out = [], {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        for pos, line in enumerate((t or "").split("\n")):
            ws = line.lower().split()
            if not ws:
                continue
            if any(alike(ws, s) for s in seen):
                out.setdefault(i, []).append(pos)
            seen.append(ws)
    return out


def test_matches_brute_force_on_edited_lines(spark):
    rng = random.Random(7)
    base = [[rng.choice("abcdefgh") + str(rng.randint(0, 3)) for _ in range(n)] for n in [3, 7, 8, 8, 9, 15, 16, 17, 31, 32, 33, 64, 65, 70] * 3]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            ws = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 1, 2])):
                at = rng.choice([0, len(ws) - 1, rng.randrange(len(ws))])
                kind = rng.randrange(3)
                if kind == 0:
                    ws[at] = "new" + str(rng.randint(0, 2))
                elif kind == 1:
                    ws.insert(at, rng.choice([ws[at], "ins"]))
                elif len(ws) > 1:
                    del ws[at]
            lines.append(" ".join(ws) if rng.random() < 0.7 else "  ".join(ws).title())
        docs.append((i, "\n".join(lines)))
    got = {r.doc: list(r.removed) for r in repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_edges(spark):
    nine = "one two three four five six seven eight nine"
    docs = [
        (5, nine + "\n\n \nshort line"), (1, nine.replace("nine", "NINE") + "\nkeep"), (2, nine.replace("five", "5") + "\nSHORT  line\n"), (3, None), (4, ""),
        (6, "w " * 30000), (7, "w " * 30001), (8, "a\nb\nA"), (8, "a\nb\nA"), (None, "zz"), (9, "zz\nx"),
    ]
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, removed string")
    rows = dedup_lines(df).collect()
    assert len(rows) == len(docs)
    out = {r.doc_id: r for r in rows}
    assert out[1].text == docs[1][1] and list(out[2].removed) == [0] and out[2].text == "SHORT  line\n"
    assert out[5].n_lines == 2 and list(out[5].removed) == [0, 3] and out[5].text == ""
    assert out[3].text is None and out[3].n_lines == 0 and out[4].text == ""
    assert out[6].n_near == 0 and (out[7].n_near, out[7].text) == (1, "")
    assert [r.text for r in rows if r.doc_id == 8] == ["a\nb", "a\nb"]
    assert out[None].text == "zz" and out[9].text == "x"
    assert dedup_lines(df.limit(0)).count() == 0


def test_rows_that_share_an_id_lose_their_own_lines_only(spark):
    near = "one two three four five six seven eight nine"
    docs = [(0, "same line here"), (1, "same line here"), (1, "a unique text of its own"), (1, None), (2, near), (3, "own\n" + near + " ten"), (3, near + " ten\nother"), (None, "x"), (None, "y\nx")]
    rows = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = sorted((str(r.doc_id), r.text) for r in rows if r.text is not None)
    assert [g for g in got if g[0] in "012"] == [("0", "same line here"), ("1", ""), ("1", "a unique text of its own"), ("2", near)]
    assert [t for i, t in got if i == "3"] == ["other", "own"]
    # of two rows the one whose text has the smaller hash comes first
    assert sorted(t for i, t in got if i == "None") in (["", "y\nx"], ["x", "y"])


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string")
    plan = dedup_lines(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
