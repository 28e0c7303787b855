from collections import defaultdict

from lineweave.llm import line_dedup


def brute(rows, min_sites):
    sites, first = defaultdict(set), {}
    for i, text, site in rows:
        for line in (text or "").split("\n"):
            key = line.strip(" \t\r")
            if key:
                if site is not None:
                    sites[key].add(site)
                if i is not None:
                    first[key] = min(i, first.get(key, i))
    out = []
    for i, text, _ in rows:
        lines = (text or "").split("\n")
        gone = [len(sites[x.strip(" \t\r")]) >= min_sites and first.get(x.strip(" \t\r")) != i for x in lines]
        out.append((i, "\n".join(x for x, g in zip(lines, gone) if not g), sum(bool(x.strip(" \t\r")) for x in lines), sum(gone)))
    return sorted(out, key=repr)


def test_against_brute_force(docs):
    rows = [(i, "\n".join([f"own {i}", " menu ", "", "near" if i < 4 else "far", "menu"]), f"s{i % 6}") for i in range(12)]
    rows += [(None, "menu\nx", "s9"), (20, None, "s1"), (21, "", None), (22, "menu\r\n\r\nrest", None), (3, rows[3][1], "s3")]
    got = line_dedup.dedup_lines(docs(*rows), min_sites=4).collect()
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got), key=repr) == brute(rows, 4)


def test_sketches_decide_lines_far_above_the_threshold(docs):
    rows = [(i, "everywhere\nlocal", f"s{i}") for i in range(60)]
    spread = line_dedup.spread_lines(docs(*rows), min_sites=20).collect()
    assert [r["exact"] for r in spread] == [False, False] and all(r["_first"] == 0 for r in spread)


def test_columns_and_empty_table(docs):
    df = line_dedup.dedup_lines(docs((1, "a")).withColumnRenamed("kept", "n_lines"))
    assert sorted(df.columns) == ["doc_id", "n_lines", "n_removed", "source", "text"] and df.first()["n_lines"] == 1
    assert line_dedup.dedup_lines(docs((1, "a")).limit(0)).count() == 0
