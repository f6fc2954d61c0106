"""Columns of the queries that SQL can express, against DuckDB over whole tables; the pipeline on odd tables."""

import duckdb
import pytest

from millrace.llm import queries

SF = "/root/testdata/sf0.01"
WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

CASES = {
    "op1_mix": (
        ["doc_id", "size", "source_size", "target"],
        # water levels by repeated capping: as many rounds as there are sources would be needed, ten settle these
        f"""WITH RECURSIVE d AS (SELECT doc_id, source, {WORDS} AS size FROM documents),
        s AS (SELECT source, sum(size) AS n, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS w FROM d GROUP BY source),
        r AS (SELECT 0 AS i, source, n, w, NULL::DOUBLE AS capped FROM s
          UNION ALL SELECT i + 1, source, n, w, CASE WHEN capped IS NOT NULL THEN capped
            WHEN w * (1.5 * sum(n) OVER () - coalesce(sum(capped) OVER (), 0)) / sum(w) FILTER (capped IS NULL) OVER () > 2 * n THEN 2.0 * n END FROM r WHERE i < 10),
        t AS (SELECT source, n, round(coalesce(capped, w * (1.5 * sum(n) OVER () - coalesce(sum(capped) OVER (), 0)) / sum(w) FILTER (capped IS NULL) OVER ()), 3) AS target FROM r WHERE i = 10)
        SELECT doc_id, size, t.n::BIGINT AS source_size, t.target FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source""",
    ),
    "op6_url_filter": (
        ["page_id", "host", "path", "rule"],
        """WITH p AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        q AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
        r(h, f) AS (VALUES ('com', '/'), ('example.com', '/en/'), ('www.example.com', '/en/'), ('net', '/es/'), ('net', '/fr/'))
        SELECT page_id, any_value(host) AS host, any_value(path) AS path, arg_max(h || f, length(h || f)) AS rule FROM q LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f) GROUP BY page_id""",
    ),
    "op9_fingerprint": (
        ["doc_id", "n_chars", "edited_sha256"],
        """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id) AS i, count(*) OVER () AS n FROM documents),
        e AS (SELECT a.doc_id, length(a.t) AS n_chars, left(a.t, length(a.t) - length(a.t) // 4) || left(b.t, length(a.t) // 4) AS e FROM d a JOIN d b ON b.i = a.i % a.n + 1)
        SELECT doc_id, n_chars, sha256(e) AS edited_sha256 FROM e""",
    ),
    "op10_secrets": (
        ["doc_id", "n_assign", "n_access", "n_hex"],
        r"""SELECT doc_id,
        len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6)) AS n_assign,
        len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access,
        len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex FROM documents""",
    ),
    "op2_pii": (
        ["doc_id", "n_email", "n_ip", "n_phone"],
        r"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
        len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: list_max(list_transform(string_split(x, '.'), lambda y: y::HUGEINT)) <= 255)) AS n_ip,
        len(list_filter(regexp_extract_all(coalesce(text, ''), '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15)) AS n_phone FROM documents""",
    ),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_columns_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    names, sql = CASES[name]
    plain = lambda r: tuple(round(float(x), 3) if isinstance(x, float) else x for x in r)
    got = sorted(map(plain, queries.QUERIES[name](spark, SF).select(*names).collect()), key=repr)
    want = sorted(map(plain, con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()), key=repr)
    assert got == want


def test_held_out_rows_and_texts_without_letters(spark):
    import zlib

    rows = {r.doc_id: r for r in queries.op8_language(spark, SF).collect()}
    for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall():
        assert rows[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert (rows[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))


def test_pieces_cover_every_document(spark):
    from collections import defaultdict

    pieces = defaultdict(list)
    for r in queries.op7_pack(spark, SF).collect():
        pieces[r.doc_id].append((r.piece, r.start, r.length))
    ids = {i for (i,) in duckdb.sql(f"SELECT doc_id FROM '{SF}/documents.parquet'").fetchall()}
    assert set(pieces) == ids
    for parts in pieces.values():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(parts)):
            assert (piece, start) == (k, at) and 0 < length <= 1024
            at += length


@pytest.mark.parametrize("texts", [[], [None, None], ["12 34", None]])
def test_pipeline_of_odd_tables(spark, tmp_path, texts):
    import corpus_pipeline as P

    rows = [(None if i else 1, t, None, None, None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
