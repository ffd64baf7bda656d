"""Registered queries return whole results: against brute force over all rows of small tables."""

from sparkloom.plans import registry


def write(spark, rows, schema, tmp_path, name):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_t1_documents_has_no_row_cap(spark, tmp_path):
    import datetime

    day = datetime.date(2024, 1, 1)
    rows = [(k, k % 50, "F" if k % 5 else "O", day + datetime.timedelta(k % 300)) for k in range(1, 1501)]
    sf = write(spark, rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate date", tmp_path, "orders")
    kept = [(k, f"{d}T00:00:00Z" if k % 5 else "") for k, _, s, d in rows if s == "F" and k % 3]
    want = [f"obj-{k}" for k, _ in sorted(sorted(kept, key=lambda r: f"obj-{r[0]}"), key=lambda r: r[1], reverse=True)]
    assert len(want) == 800
    assert [r.storage_object_id for r in registry.QUERIES["t1_documents"](spark, sf).collect()] == want


def documents(spark, tmp_path):
    rows = [(i, "\n".join(f"{i} line {j} " + "x" * (j * 37 % 150) for j in range(2 + i * 17 % 120)), "s%d" % (i % 2)) for i in range(12)] + [(12, None, "s0"), (13, "é\n" * 900, "s1")]
    rows = [(i, t, s, None if i == 5 or t is None else len(t)) for i, t, s in rows]
    assert any((n or 0) >= 4000 for *_, n in rows)
    return rows, write(spark, rows, "doc_id long, text string, source string, n_chars long", tmp_path, "documents")


def test_g3_running_index_counts_long_documents(spark, tmp_path):
    rows, sf = documents(spark, tmp_path)
    want, at = set(), {}
    for i, text, source, _ in rows:
        for piece, _ in enumerate((text or "").split("\n")):
            want.add((source, i, piece, at.get(source, 0)))
            at[source] = at.get(source, 0) + 1
    got = registry.QUERIES["g3_running_index"](spark, sf).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_n7_merge_takes_long_documents(spark, tmp_path):
    rows, sf = documents(spark, tmp_path)
    want = set()
    for i, text, *_ in rows:
        done, held = [], None
        for line in (text or "").split("\n"):
            held = line if held is None else held + "\n" + line
            if len(held.encode()) >= 400:
                done.append(held)
                held = None
        done += [] if held is None else [held]
        want |= {(i, k, len(c.encode())) for k, c in enumerate(done)}
    got = registry.QUERIES["n7_merge"](spark, sf).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_e8_matched_links_takes_all_words(spark, tmp_path):
    first = " ".join(f"word{i:02}" for i in range(30)) + " abc word03"
    rows = [(1, 0, first), (1, 1, "word29 word02 word15 abc"), (1, 2, None), (2, 0, "other"), (2, 1, "word29")]
    sf = write(spark, rows, "conv_id long, turn int, text string", tmp_path, "conversations")
    got = {(r.page_id, r.chunk_index): r.links for r in registry.QUERIES["e8_matched_links"](spark, sf).collect()}
    assert got == {(1, 0): 30, (1, 1): 3, (1, 2): 0, (2, 0): 1, (2, 1): 0}


def test_h11_display_cut_takes_any_key(spark, tmp_path):
    rows = [(k, n, k * n) for k in range(36, 60) for n in (2, 1)]
    sf = write(spark, rows, "l_orderkey long, l_linenumber int, l_partkey long", tmp_path, "lineitem")
    assert [tuple(r) for r in registry.QUERIES["h11_display_cut"](spark, sf).collect()] == sorted(rows)[:25]
