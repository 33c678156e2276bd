"""Queries of manifests, structure and chunks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import chunking, manifest, oplog, structure
from corpusloom.plans import derived as D
from corpusloom.registry import query, table

BOILERPLATE = ("(Released under|Licensed under) the ",)
NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {rows} t({columns})")


#: A manifest's row for each document, with one mistake or several in most of them.
_BAD = """rows AS (SELECT doc_id AS line, CASE WHEN doc_id % 7 = 0 THEN 'Guide ' || doc_id ELSE 'g' || doc_id END id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN doc_id || '.txt' ELSE doc_id || '.pdf' END path, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Guide' END title,
  CASE WHEN doc_id % 4 = 0 THEN 'one' ELSE '1.' || doc_id % 13 END AS version, CASE doc_id % 6 WHEN 0 THEN 'R2026x' WHEN 1 THEN 'R20x' ELSE '' END release_min, CASE doc_id % 6 WHEN 0 THEN 'R2021x' ELSE '' END release_max,
  CASE doc_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'All;x' ELSE 'all' END groups, CASE WHEN doc_id % 9 = 0 THEN 'maybe' ELSE 'yes' END external_ok, CASE WHEN doc_id % 10 = 0 THEN 'nothing' ELSE 'upgrade' END category, CASE WHEN doc_id % 11 = 0 THEN '13/13/2026' ELSE '10/8/2026' END added FROM documents)"""


def _bad(spark, d):
    i = F.col("doc_id")
    text = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    pick = lambda n, otherwise, **cases: F.coalesce(*(F.when(i % n == int(k[1:]), v) for k, v in cases.items()), F.lit(otherwise) if isinstance(otherwise, str) else otherwise)
    return table(spark, d, "documents").select(
        i.alias("line"), pick(7, text("g", i), _0=text("Guide ", i)).alias("doc_id"), pick(5, text(i, ".pdf"), _0=F.lit(""), _1=text(i, ".txt")).alias("path"), pick(3, "Guide", _0=F.lit("")).alias("title"), pick(4, text("1.", i % 13), _0=F.lit("one")).alias("version"),
        pick(6, "", _0=F.lit("R2026x"), _1=F.lit("R20x")).alias("release_min"), pick(6, "", _0=F.lit("R2021x")).alias("release_max"), pick(8, "all", _0=F.lit(""), _1=F.lit("All;x")).alias("allowed_groups"), pick(9, "yes", _0=F.lit("maybe")).alias("external_ok"),
        pick(10, "upgrade", _0=F.lit("nothing")).alias("category"), pick(11, "10/8/2026", _0=F.lit("13/13/2026")).alias("added"),
    )


@query(f"""WITH {_BAD} SELECT line, list_filter([CASE WHEN id LIKE 'Guide%' THEN 'doc_id ''' || id || ''' must be a lowercase slug' END,
  CASE WHEN path = '' THEN 'path is empty' WHEN path LIKE '%.txt' THEN 'unsupported file type ''txt''' END, CASE WHEN title = '' THEN 'title is empty' END, CASE WHEN version = 'one' THEN 'version ''one'' must look like 1.0 or 3.2' END,
  CASE WHEN release_min = 'R20x' THEN 'invalid release ''R20x''' END, CASE WHEN release_max <> '' THEN 'release_min R2026x is after release_max R2021x' END, CASE WHEN groups = '' THEN 'allowed_groups is empty' END,
  CASE WHEN external_ok = 'maybe' THEN 'external_ok ''maybe'' must be true or false' END, CASE WHEN category = 'nothing' THEN 'category ''nothing'' is not known' END, CASE WHEN added LIKE '13%' THEN 'added ''13/13/2026'' must be a date' END,
  CASE WHEN groups LIKE 'All%' THEN 'group ''All'' must be lowercase' END], lambda e: e IS NOT NULL) AS errors FROM rows""")
def manifest_validate(spark, d):
    return manifest.validate(_bad(spark, d)).select("line", "errors")


@query("""WITH r AS (SELECT doc_id AS line, 'g' || doc_id % 150 id, doc_id % 170 || '.pdf' path, 'f' || doc_id % 12 family, [1 + doc_id % 5, doc_id % 3] v FROM documents),
i AS (SELECT * FROM r WHERE line = (SELECT min(line) FROM r x WHERE x.id = r.id)), p AS (SELECT * FROM i WHERE line = (SELECT min(line) FROM i x WHERE x.path = i.path)), t AS (SELECT family, max(v) AS top FROM p GROUP BY family)
SELECT line, id AS doc_id, v = top AS is_latest FROM p JOIN t USING (family)""")
def manifest_listing(spark, d):
    """Of rows that repeat ids and paths, those that are listed, and which are their family's latest."""
    i, text = F.col("doc_id"), lambda c: c.cast("string")
    rows = table(spark, d, "documents").select(i.alias("line"), F.concat(F.lit("g"), text(i % 150)).alias("doc_id"), F.concat(text(i % 170), F.lit(".pdf")).alias("path"), F.concat(F.lit("f"), text(i % 12)).alias("family"), F.concat_ws(".", text(1 + i % 5), text(i % 3)).alias("version"))
    return manifest.with_latest(manifest.listing(rows)[0]).select("line", "doc_id", "is_latest")


@query(f"WITH {D.MANIFEST}, h AS (SELECT doc_id, md5(text) h FROM manifest), f AS (SELECT h, min(doc_id) first_line FROM h GROUP BY h) SELECT doc_id AS line, first_line FROM h JOIN f USING (h) WHERE doc_id > first_line")
def manifest_duplicates(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("line"), F.md5("text").alias("content_hash"))
    return manifest.duplicates(rows, "content_hash").select("line", "first_line")


@query(f"WITH {D.MANIFEST}, k AS (SELECT *, list_transform(string_split(version, '.'), lambda x: x::INT) key FROM manifest), t AS (SELECT family, max(key) AS top FROM k GROUP BY family) SELECT id, family, version, key = top AS is_latest FROM k JOIN t USING (family)")
def family_latest(spark, d):
    return manifest.with_latest(D.manifest(spark, d)).select("id", "family", "version", "is_latest")


@query(f"WITH {D.MANIFEST}, f AS (SELECT family, version, min(doc_id) first_line FROM manifest GROUP BY ALL) SELECT doc_id AS line, family, version, first_line FROM manifest JOIN f USING (family, version) WHERE doc_id > first_line")
def family_version_clash(spark, d):
    return manifest.version_clashes(D.manifest(spark, d).withColumn("line", F.col("doc_id")).select("line", "family", "version"))


#: A file's name for each document, by its number: with a release written one way or another, or with none.
_NAMED = """named AS (SELECT doc_id, doc_id % 23 + 2013 y, CASE doc_id % 6 WHEN 0 THEN 'CCM ' || (doc_id % 23 + 13) || 'x guide ' || doc_id WHEN 1 THEN 'R' || (doc_id % 23 + 2013) || 'xFP17 ' || lang
  WHEN 2 THEN (doc_id % 23 + 13) || '0x faster, 1.' || (doc_id % 23 + 13) || 'x more' WHEN 3 THEN 'from V6 to R' || (doc_id % 23 + 13) || 'xGA' WHEN 4 THEN 'V6R' || (doc_id % 23 + 2013) || 'x and 2024x' ELSE source || '_' || lang END AS name FROM documents)"""


def _named(spark, d):
    i, text = F.col("doc_id"), lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    y, long = i % 23 + 13, i % 23 + 2013
    kinds = (text("CCM ", y, "x guide ", i), text("R", long, "xFP17 ", F.col("lang")), text(y, "0x faster, 1.", y, "x more"), text("from V6 to R", y, "xGA"), text("V6R", long, "x and 2024x"))
    name = text(F.col("source"), "_", F.col("lang"))
    for k, kind in enumerate(kinds):
        name = F.when(i % 6 == k, kind).otherwise(name)
    return table(spark, d, "documents").select("doc_id", name.alias("name"))



@query(f"WITH {_NAMED} SELECT doc_id, name, CASE WHEN doc_id % 6 IN (0, 1, 3) THEN [y::INT] WHEN doc_id % 6 = 4 THEN list_sort(list_distinct([y::INT, 2024])) ELSE []::INT[] END AS years FROM named")
def release_tokens(spark, d):
    return _named(spark, d).select("doc_id", "name", F.array_sort(X.releases_named(F.col("name"))).alias("years"))


_DAYS = """days AS (SELECT doc_id, doc_id % 3 form, 1990 + doc_id % 50 y, 1 + (doc_id * 7) % 14 m, 1 + (doc_id * 5) % 33 n FROM documents),
  dates AS (SELECT *, CASE form WHEN 0 THEN y || '-' || m || '-' || n WHEN 1 THEN m || '/' || n || '/' || y ELSE n || '.' || m || '.' || y END AS t FROM days)"""


@query(f"WITH {_DAYS} SELECT doc_id, t, strftime(try_cast(y || '-' || m || '-' || n AS DATE), '%Y-%m-%d') AS iso FROM dates")
def normalise_dates(spark, d):
    i = F.col("doc_id")
    y, m, n = ((1990 + i % 50).cast("string"), (1 + (i * 7) % 14).cast("string"), (1 + (i * 5) % 33).cast("string"))
    t = F.when(i % 3 == 0, F.concat_ws("-", y, m, n)).when(i % 3 == 1, F.concat_ws("/", m, n, y)).otherwise(F.concat_ws(".", n, m, y))
    return table(spark, d, "documents").select("doc_id", t.alias("t")).withColumn("iso", X.iso_date(F.col("t")))


_STEMS = """stems AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN source || '_V' || doc_id % 7 || '.' || doc_id % 3 WHEN 1 THEN 'Set-up ' || lang || ' v' || doc_id % 9 WHEN 2 THEN 'ENOVIA V' || doc_id % 9
  WHEN 3 THEN 'Notes ' || source || ' (Rev ' || doc_id % 4 || ') Internal' ELSE 'Über ' || source || ' & ' || lang END AS stem,
  CASE doc_id % 5 WHEN 0 THEN source WHEN 1 THEN 'Set-up ' || lang WHEN 3 THEN 'Notes ' || source END AS cut,
  CASE doc_id % 5 WHEN 0 THEN doc_id % 7 || '.' || doc_id % 3 WHEN 1 THEN doc_id % 9 || '.0' WHEN 3 THEN doc_id % 4 || '.0' END AS version FROM documents)"""


@query(f"WITH {_STEMS} SELECT doc_id, coalesce(cut, stem) AS base, version, trim(regexp_replace(lower(coalesce(cut, stem)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM stems")
def name_versions_slugs(spark, d):
    i = F.col("doc_id")
    text = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    stem = F.when(i % 5 == 0, text(F.col("source"), "_V", i % 7, ".", i % 3)).when(i % 5 == 1, text("Set-up ", F.col("lang"), " v", i % 9)).when(i % 5 == 2, text("ENOVIA V", i % 9)).when(i % 5 == 3, text("Notes ", F.col("source"), " (Rev ", i % 4, ") Internal")).otherwise(text("Über ", F.col("source"), " & ", F.col("lang")))
    rows = table(spark, d, "documents").select("doc_id", stem.alias("stem"))
    base = X.name_base(F.col("stem"))
    return rows.select("doc_id", base.alias("base"), X.name_version(F.col("stem")).alias("version"), X.slug(base).alias("slug"))


_PATHS = "('Install_Guide', 'installation'), ('ssl/ADFS sso', 'installation'), ('Migration-notes', 'upgrade'), ('LDAP', 'authentication'), ('tuning/checklist', 'performance'), ('nothing', 'administration'), ('role overview', 'functional'), ('cloud-security', 'infrastructure'), ('Troubleshoot install', 'troubleshooting')"


@query(f"WITH kinds AS (SELECT *, row_number() OVER () - 1 k FROM (VALUES {_PATHS}) t(part, category)) SELECT doc_id, lang || '/' || part || '_' || doc_id || '.pdf' AS path, category FROM documents JOIN kinds ON k = doc_id % 9")
def guess_category(spark, d):
    parts = F.array(*(F.lit(p) for p in re.findall(r"\('([^']*)',", _PATHS)))
    path = F.concat(F.col("lang"), F.lit("/"), F.get(parts, (F.col("doc_id") % 9).cast("int")), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return table(spark, d, "documents").select("doc_id", path.alias("path"), X.guess_category(path).alias("category"))


#: A file for each document: forty names, some with versions, on covers one release, two or none; a few are listed already.
_FILES = """files AS (SELECT doc_id, lang || '/b' || doc_id // 6 AS folder, lang || '/b' || doc_id // 6 || '/Guide ' || doc_id % 40 || CASE WHEN doc_id % 3 = 0 THEN '_V' || (1 + doc_id % 4) || '.0' ELSE '' END || '.pdf' AS path,
  'guide-' || doc_id % 40 AS family, CASE WHEN doc_id % 3 = 0 THEN 1 + doc_id % 4 END AS v, CASE WHEN doc_id % 4 = 0 THEN 'R2023x' ELSE '' END AS release_min, md5(text) h FROM documents),
listed AS (SELECT path, 'guide-' || doc_id % 40 || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '-v2-0' END AS id, family, 1 + doc_id % 4 AS v, h FROM files WHERE doc_id % 45 = 0)"""
_SETTLED = f"""{_FILES}, new AS (SELECT * FROM files WHERE doc_id % 45 <> 0),
once AS (SELECT * FROM new WHERE h NOT IN (SELECT h FROM listed) AND path = (SELECT min(path) FROM new n WHERE n.h = new.h)),
ranks AS (SELECT *, family IN (SELECT family FROM listed) known, (family, v) IN (SELECT family, v FROM listed) has, max(v) OVER (PARTITION BY family) top,
  row_number() OVER (PARTITION BY family, v IS NULL ORDER BY (family, folder) NOT IN (SELECT family, folder FROM once WHERE v IS NOT NULL), path) i FROM once),
settled AS (SELECT path, family, family || coalesce('-v' || v || '-0', '') AS want, coalesce(v IS NOT NULL AND has, false) OR (v IS NULL AND (known OR i > 1)) AS own_family, release_min,
  CASE WHEN v IS NULL AND NOT known AND i = 1 AND top IS NOT NULL THEN (top + 1) || '.0' ELSE coalesce(v || '.0', '1.0') END AS version FROM ranks)"""


def _files(spark, d):
    i, text = F.col("doc_id"), lambda c: c.cast("string")
    name = F.concat(F.lit("Guide "), text(i % 40), F.when(i % 3 == 0, F.concat(F.lit("_V"), text(1 + i % 4), F.lit(".0"))).otherwise(""), F.lit(".pdf"))
    cover = F.when(i % 4 == 0, "for R2023x").when(i % 4 == 1, "R2020x or R2021x").otherwise("")
    return table(spark, d, "documents").select("doc_id", F.concat_ws("/", "lang", F.concat(F.lit("b"), text(F.floor(i / 6))), name).alias("path"), cover.alias("cover"), F.md5("text").alias("content_hash"))


def _listed(spark, d):
    i, family = F.col("doc_id"), F.concat(F.lit("guide-"), (F.col("doc_id") % 40).cast("string"))
    return _files(spark, d).where("doc_id % 45 = 0").select("path", F.concat(family, F.when(i % 2 == 0, "").otherwise("-v2-0")).alias("doc_id"), family.alias("family"), F.concat((1 + i % 4).cast("string"), F.lit(".0")).alias("version"), "content_hash")


@query(f"WITH {_FILES} SELECT path, family || coalesce('-v' || v || '-0', '') AS doc_id, family, coalesce(v || '.0', '1.0') AS version, release_min FROM files")
def manifest_drafts(spark, d):
    return manifest.draft(_files(spark, d).drop("doc_id")).select("path", "doc_id", "family", "version", "release_min")


@query(f"WITH {_SETTLED} SELECT path, family, version, own_family FROM settled")
def manifest_families(spark, d):
    """Families of the new files that are no copies."""
    new = manifest.unlisted(_files(spark, d), _listed(spark, d))
    copies = manifest.content_copies(new, _listed(spark, d))
    return manifest.resolve_families(manifest.draft(new.join(copies, "path", "left_anti").drop("doc_id")), _listed(spark, d)).select("path", "family", "version", "own_family")


def _one_by_one(drafts: str, ids: str) -> str:
    """SQL that gives drafts(path, want, w1, base, i) their ids in turn; ids(t) is the list of those taken."""
    return f"""drafts AS ({drafts}), ids AS ({ids}),
run AS (
  SELECT 0::BIGINT i, '' path, '' doc_id, t FROM ids
  UNION ALL
  SELECT i, path, id, list_append(t, id) FROM (
    SELECT d.i, d.path, r.t, CASE WHEN NOT list_contains(r.t, d.want) THEN d.want WHEN NOT list_contains(r.t, d.w1) THEN d.w1 ELSE d.base || '-' || list_filter(range(2, len(m) + 3), lambda n: NOT list_contains(m, n))[1] END id
    FROM (SELECT i, t FROM run) r JOIN drafts d ON d.i = r.i + 1, LATERAL (SELECT list_transform(list_filter(r.t, lambda x: starts_with(x, d.base || '-')), lambda x: try_cast(x[len(d.base) + 2:] AS BIGINT)) m) z))"""


_TURNS = "SELECT *, row_number() OVER (ORDER BY split, string_split(path, '/')) i, regexp_replace(left(regexp_extract(path, '([^/]*)/[^/]*$', 1) || '-' || want, 60), '-+$', '') w1, left(want, 56) base FROM ({})"


@query(f"""WITH RECURSIVE {_SETTLED}, {_one_by_one(_TURNS.format("SELECT path, want, own_family split FROM settled"), "SELECT list(DISTINCT id) t FROM listed")}
SELECT path, doc_id, CASE WHEN own_family THEN doc_id ELSE family END AS family, version, release_min FROM run JOIN settled USING (path) WHERE i > 0""")
def manifest_scan(spark, d):
    """What a scan drafts: copies get no row, families are settled, ids are given to those that keep their family first."""
    rows, _ = manifest.scan(_files(spark, d).drop("doc_id"), _listed(spark, d))
    return rows.select("path", "doc_id", "family", "version", "release_min")


#: Wanted ids collide, in several folders, some with numbers of others; many numbers are taken, with gaps.
_WANTS = "SELECT lang || '/' || source || '/' || doc_id || '.pdf' path, doc_id % 11 = 0 split, CASE WHEN doc_id % 17 = 0 THEN source || '-g-' || doc_id % 60 WHEN doc_id % 13 = 0 THEN 'g-' || doc_id % 60 || '-' || (2 + doc_id % 9) ELSE 'g-' || doc_id % 60 END want FROM documents"
_TAKEN = "SELECT list(id) t FROM (SELECT DISTINCT unnest(['g-' || doc_id % 60 || '-' || (2 + (doc_id // 60) % 7 * 2), 'g-' || doc_id % 20]) id FROM documents WHERE doc_id % 3 = 0)"


@query(f"WITH RECURSIVE {_one_by_one(_TURNS.format(_WANTS), _TAKEN)} SELECT path, doc_id FROM run WHERE i > 0")
def manifest_ids(spark, d):
    """The id of each draft, as one after the other would take them."""
    i, text = F.col("doc_id"), lambda c: c.cast("string")
    docs, base = table(spark, d, "documents"), F.concat(F.lit("g-"), text(i % 60))
    want = F.when(i % 17 == 0, F.concat("source", F.lit("-"), base)).when(i % 13 == 0, F.concat(base, F.lit("-"), text(2 + i % 9))).otherwise(base)
    drafts = docs.select(F.concat_ws("/", "lang", "source", F.concat(text(i), F.lit(".pdf"))).alias("path"), (i % 11 == 0).alias("split"), want.alias("doc_id"))
    taken = docs.where("doc_id % 3 = 0").select(F.explode(F.array(F.concat(base, F.lit("-"), text(2 + F.floor(i / 60) % 7 * 2)), F.concat(F.lit("g-"), text(i % 20)))).alias("doc_id"))
    return manifest.unique_ids(drafts, taken)


@query("""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE '2025-05-05' END added, CASE WHEN doc_id % 5 = 0 THEN '' ELSE '2026-01-02' END d, CASE WHEN doc_id % 7 = 0 THEN 'R2022x' ELSE '' END low FROM documents),
c AS (SELECT *, added = '' AND d <> '' AS dated, CASE WHEN low <> '' THEN '' WHEN doc_id % 3 = 0 THEN 'name' WHEN doc_id % 4 = 0 THEN 'first pages' ELSE '' END AS origin FROM r)
SELECT doc_id, CASE WHEN dated THEN d ELSE added END AS added, CASE origin WHEN '' THEN low WHEN 'name' THEN 'R2021x' ELSE 'R2023x' END AS release_min,
  list_filter([CASE WHEN dated THEN 'added = ' || d END, CASE WHEN origin = 'name' THEN 'release R2021x+ (from the name)' END, CASE WHEN origin = 'first pages' THEN 'release R2023x+ (from the first pages)' END], lambda x: x IS NOT NULL) AS changes FROM c""")
def manifest_backfill(spark, d):
    i = F.col("doc_id")
    path = F.concat(F.lit("g/Tool "), i.cast("string"), F.when(i % 3 == 0, " R2021x").otherwise(""), F.lit(".pdf"))
    rows = table(spark, d, "documents").select(
        "doc_id", path.alias("path"), F.when(i % 2 == 0, "").otherwise("2025-05-05").alias("added"), F.when(i % 7 == 0, "R2022x").otherwise("").alias("release_min"), F.lit("").alias("release_max"), F.lit("").alias("review"),
        F.when(i % 5 == 0, "").otherwise("2026-01-02").alias("file_date"), F.when(i % 4 == 0, "for R2023x").when(i % 4 == 1, "R2020x or R2021x").otherwise("").alias("cover"),
    )
    return manifest.backfill(rows)


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unlisted_files(spark, d):
    files = table(spark, d, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"))
    listed = table(spark, d, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"))
    return manifest.unlisted(files, listed).select("doc_id")


@query("WITH h AS (SELECT d.doc_id, lpad(d.doc_id::VARCHAR, 9, '0') p, md5(text) h, l.doc_id IS NOT NULL listed FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)), k AS (SELECT h, min(doc_id) id FROM h WHERE listed GROUP BY h), f AS (SELECT h, min(p) fp FROM h WHERE NOT listed GROUP BY h) SELECT p AS path, CASE WHEN id IS NOT NULL THEN 'manifest doc_id ''' || id || '''' ELSE 'new file ''' || fp || '''' END copy_of FROM h LEFT JOIN k USING (h) JOIN f USING (h) WHERE NOT listed AND (id IS NOT NULL OR p > fp)")
def content_copies(spark, d):
    files = table(spark, d, "documents").select("doc_id", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), F.concat(F.md5("text"), F.lit("")).alias("content_hash"))
    listed = files.join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return manifest.content_copies(files.select("path", "content_hash"), listed)


@query("WITH l AS (SELECT DISTINCT doc_id FROM labels) SELECT id, state FROM (SELECT coalesce(d.doc_id, l.doc_id) id, CASE WHEN d.doc_id IS NULL THEN 'not parsed' WHEN l.doc_id IS NULL THEN 'not listed' ELSE 'ok' END state FROM (SELECT doc_id FROM documents WHERE lang <> 'fr') d FULL JOIN l USING (doc_id))")
def status_reconcile(spark, d):
    stored = table(spark, d, "documents").where("lang <> 'fr'").select("doc_id", F.lit("ok").alias("status"))
    return manifest.reconcile(stored, table(spark, d, "labels").select("doc_id").distinct()).select(F.col("doc_id").alias("id"), "state")


@query("SELECT CASE WHEN source IS NULL OR source = '' THEN '.' ELSE source END AS folder, count(*) files FROM documents GROUP BY ALL")
def files_by_folder(spark, d):
    return manifest.by_folder(table(spark, d, "documents").select(F.concat_ws("/", F.nullif("source", F.lit("")), F.col("doc_id").cast("string")).alias("path")))


@query(f"WITH {D.MANIFEST} SELECT id, CASE WHEN release_max = 9999 THEN 'R' || release_min || 'x+' ELSE 'R' || release_min || 'x-R' || release_max || 'x' END AS label FROM manifest WHERE 2020 BETWEEN release_min AND release_max")
def release_range_filter(spark, d):
    return D.manifest(spark, d).where(F.lit(2020).between(F.col("release_min"), F.col("release_max"))).select("id", X.release_label(F.col("release_min"), F.col("release_max")).alias("label"))


@query(f"WITH {D.LINES} SELECT doc_id, pos, regexp_replace(regexp_replace(lower(regexp_replace(line, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g'), '[0-9]+', '#', 'g') AS key FROM lines")
def line_keys(spark, d):
    return D.lines(spark, d).select("doc_id", "pos", X.line_key(F.col("line")).alias("key"))


_KEYS = "keys AS (SELECT doc_id, page, length(line) n, regexp_replace(regexp_replace(lower(regexp_replace(line, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g'), '[0-9]+', '#', 'g') AS key, pos, line FROM lines)"
_REPEATED = "np AS (SELECT doc_id, max(page) np FROM lines GROUP BY doc_id), rep AS (SELECT doc_id, key, count(DISTINCT page) pages FROM keys WHERE n <= 200 GROUP BY ALL), again AS (SELECT doc_id, key, pages FROM rep JOIN np USING (doc_id) WHERE pages >= greatest(3.0, 0.3 * np))"


def _line_elements(spark: SparkSession, d: str) -> DataFrame:
    return D.lines(spark, d).select("doc_id", F.col("pos").alias("ordinal"), F.lit("text").alias("kind"), F.col("line").alias("text"), "page")


@query(f"WITH {D.LINES}, {_KEYS}, {_REPEATED} SELECT doc_id, key, pages FROM again")
def repeated_lines(spark, d):
    return structure.repeated_lines(_line_elements(spark, d))


@query(f"WITH {D.LINES}, {_KEYS}, {_REPEATED} SELECT doc_id, count(*) kept FROM keys k WHERE NOT EXISTS (SELECT 1 FROM again a WHERE a.doc_id = k.doc_id AND a.key = k.key) AND NOT regexp_matches(line, '^(?i)(Released under|Licensed under) the ') GROUP BY doc_id")
def furniture_removed(spark, d):
    return structure.without_furniture(_line_elements(spark, d), BOILERPLATE).groupBy("doc_id").agg(F.count("*").alias("kept"))


_TOC = "toc AS (SELECT doc_id, p AS page, 20 + doc_id % 300 AS n_pages FROM (SELECT doc_id, unnest([doc_id % 40 + 1, doc_id % 40 + 2 + doc_id % 4, doc_id % 40 + 5 + doc_id % 3, doc_id % 40 + 20]) p FROM documents))"


@query(f"WITH {_TOC}, gaps AS (SELECT *, CASE WHEN page - lag(page) OVER w > 2 THEN 1 ELSE 0 END gap, min(page) OVER (PARTITION BY doc_id) first FROM (SELECT DISTINCT * FROM toc) WINDOW w AS (PARTITION BY doc_id ORDER BY page)), runs AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id ORDER BY page) run FROM gaps) SELECT doc_id, page FROM runs WHERE run = 0 AND first <= greatest(8.0, 0.1 * n_pages)")
def toc_run(spark, d):
    """Contents pages of every document, in runs and alone, some too far in to be its contents."""
    i = F.col("doc_id")
    docs = table(spark, d, "documents")
    at = i % 40
    pages = F.array(at + 1, at + 2 + i % 4, at + 5 + i % 3, at + 20)
    tables = docs.select("doc_id", F.explode(pages).alias("page")).withColumn("kind", F.lit("toc"))
    others = docs.select("doc_id", (at + 3).alias("page"), F.lit("table").alias("kind"))
    return structure.toc_run(tables.unionByName(others), docs.select("doc_id", (20 + i % 300).alias("n_pages")))


@query("""WITH parts AS (SELECT doc_id, unnest([0, 1, 2]) "row", source, lang FROM documents),
segments AS (SELECT doc_id, "row", 0 part, (doc_id % 9 + 1) || CASE WHEN "row" = 0 THEN '' ELSE '.' || "row" END AS number, CASE "row" WHEN 0 THEN 'About ' || source WHEN 1 THEN 'Setting up ' || lang ELSE 'Ports of ' || source END AS title FROM parts
  UNION ALL SELECT doc_id, "row", 1, (doc_id % 9 + 1) || '.9', 'Notes on ' || lang FROM parts WHERE "row" = 2 UNION ALL SELECT doc_id, 3, 0, NULL, 'Appendix ' || lang FROM parts WHERE "row" = 0)
SELECT doc_id, "row", part, number, title, trim(regexp_replace(regexp_replace(' ' || regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g') || ' ', '( [0-9]+)+ ', ' ', 'g'), ' +', ' ', 'g')) AS key FROM segments""")
def toc_entries(spark, d):
    """A contents table of each document: cells that repeat, two entries in a row, an unnumbered one, its own heading."""
    text = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    n, source, lang, i = F.col("doc_id") % 9 + 1, F.col("source"), F.col("lang"), F.col("doc_id")
    cells = F.array(
        F.array(text(n, "."), text("About ", source, " ....... ", i % 90 + 1), F.lit("")),
        F.array(text(n, ".1 Setting up ", lang, " ..... ", i % 90 + 2), text(n, ".1 Setting up ", lang, " ..... ", i % 90 + 2)),
        F.array(text(n, ".2. Ports of ", source, " ..... 7 ", n, ".9. Notes on ", lang, " .... 9")),
        F.array(text("Appendix ", lang), text("Appendix ", lang), F.lit("12")),
        F.array(F.lit("Table of Contents"), F.lit("2")),
    )
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(cells).alias("row", "cells"))
    return structure.toc_entries(rows.select("doc_id", "row", structure.toc_row_text(F.col("cells")).alias("text"))).select("doc_id", "row", "part", "number", "title", "key")


_SLIDES = f"""WITH {D.ELEMENTS},
heads AS (SELECT doc_id, page, arg_min(text, ordinal) FILTER (WHERE kind = 'heading') head, count(*) FILTER (WHERE kind <> 'heading') items, count(*) FILTER (WHERE kind = 'heading') nh FROM elements GROUP BY ALL),
titled AS (SELECT *, coalesce(head, 'Slide ' || page) title FROM heads),
keyed AS (SELECT *, trim(regexp_replace(regexp_replace(' ' || regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g') || ' ', '( [0-9]+)+ ', ' ', 'g'), ' +', ' ', 'g')) AS key FROM titled),
marked AS (SELECT *, CASE WHEN head IS NOT NULL AND lag(key) OVER w = key AND lag(page) OVER w = page - 1 THEN 0 ELSE 1 END fresh FROM keyed WHERE key NOT IN ('agenda', 'contents', 'table of contents', 'proprietary disclosure statement') WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
run AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY page) r FROM marked)
SELECT doc_id, min(page)::VARCHAR AS number, arg_min(title, page) AS title, min(page) first_slide, max(page) last_slide FROM run GROUP BY doc_id, r HAVING sum(items + greatest(nh - 1, 0)) > 0"""


@query(_SLIDES)
def slide_sections(spark, d):
    return structure.slide_sections(D.elements(spark, d))


@query(f"WITH {D.ELEMENTS}, run AS (SELECT *, sum((kind <> 'list')::INT) OVER (PARTITION BY doc_id ORDER BY ordinal) r FROM elements) SELECT doc_id, min(ordinal) AS \"first\", max(ordinal) AS \"last\", string_agg('- ' || text, chr(10) ORDER BY ordinal) AS text FROM run WHERE kind = 'list' GROUP BY doc_id, r")
def list_blocks(spark, d):
    return structure.list_blocks(D.elements(spark, d))


@query(f"WITH {D.LINES}, t AS (SELECT doc_id, pos, list_transform(string_split(line, ' | '), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) c FROM lines WHERE line LIKE '% | %') SELECT doc_id, pos, '| ' || array_to_string(list_transform(list_filter(c, lambda x: x <> '' AND NOT regexp_matches(x, '^([o•▪◦–-]\\s*)+$')), lambda x: replace(x, '|', '\\|')), ' | ') || ' |' AS md FROM t WHERE len(list_filter(c, lambda x: x <> '' AND NOT regexp_matches(x, '^([o•▪◦–-]\\s*)+$'))) > 0")
def table_markdown(spark, d):
    rows = D.lines(spark, d).where(F.contains("line", F.lit(" | "))).select("doc_id", "pos", F.array(F.split("line", r" \| ")).alias("rows"))
    return rows.select("doc_id", "pos", F.get(F.split(structure.table_markdown(F.col("rows")), "\n"), F.lit(0)).alias("md")).where("md <> ''")


#: Six sections of each document; every second one's history goes, and one section is empty.
_TREE = (("1", None, 0), ("1.1", "1", 1), ("1.1.1", "1.1", 2), ("2", None, 0), ("2.1", "2", 1), ("3", None, 0))
_SECTIONS = f"""tree AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {repr(p) if p else 'NULL'}, {b})" for n, p, b in _TREE)}) t(number, parent, blocks)),
  sections AS (SELECT doc_id, number, parent, CASE WHEN number = '1.1.1' THEN (doc_id % 3)::INT ELSE blocks END n_blocks,
    CASE number WHEN '1' THEN 'In ' || source WHEN '1.1' THEN 'About ' || lang WHEN '2' THEN CASE WHEN doc_id % 2 = 0 THEN 'Document History' ELSE 'Notes' END WHEN '3' THEN 'Empty' ELSE 'Part ' || number END title FROM documents, tree)"""


def _sections(spark, d):
    tree = F.array(*(F.struct(F.lit(n).alias("number"), F.lit(p).cast("string").alias("parent"), F.lit(b).alias("blocks")) for n, p, b in _TREE))
    n, i = F.col("t.number"), F.col("doc_id")
    title = F.when(n == "1", F.concat(F.lit("In "), "source")).when(n == "1.1", F.concat(F.lit("About "), "lang")).when(n == "2", F.when(i % 2 == 0, "Document History").otherwise("Notes")).when(n == "3", "Empty").otherwise(F.concat(F.lit("Part "), n))
    rows = table(spark, d, "documents").select("doc_id", "source", "lang", F.explode(tree).alias("t"))
    return rows.select("doc_id", n.alias("number"), "t.parent", F.when(n == "1.1.1", (i % 3).cast("int")).otherwise(F.col("t.blocks")).alias("n_blocks"), title.alias("title"))



@query(f"WITH RECURSIVE {_SECTIONS}, p AS (SELECT doc_id, number, title AS path, parent FROM sections UNION ALL SELECT p.doc_id, p.number, s.title || ' > ' || p.path, s.parent FROM p JOIN sections s ON s.doc_id = p.doc_id AND s.number = p.parent) SELECT doc_id, number, path AS heading_path FROM p WHERE parent IS NULL")
def section_paths(spark, d):
    return structure.section_paths(_sections(spark, d))


@query(f"WITH {_SECTIONS}, kept AS (SELECT * FROM sections WHERE NOT (doc_id % 2 = 0 AND (number = '2' OR starts_with(number, '2.')))) SELECT doc_id, number FROM kept k WHERE n_blocks > 0 OR EXISTS (SELECT 1 FROM kept c WHERE c.doc_id = k.doc_id AND c.parent = k.number)")
def sections_dropped(spark, d):
    return structure.without_sections(_sections(spark, d)).select("doc_id", "number")


@query()
def section_tree(spark, d):
    """Sections of every web page: its headings and list items over its paragraphs."""
    return structure.build_sections(D.elements(spark, d), BOILERPLATE).select("doc_id", "ordinal", "number", "title", "level", "parent", "page_start", "page_end", F.size("blocks").alias("n_blocks"))


#: Seven blocks of each document; what stands between two commands differs from one document to the next.
_CODE = """given AS (SELECT doc_id, unnest([0, 1, 2, 3, 4, 5, 6]) i, lang, source FROM documents),
  blocks AS (SELECT doc_id, i, CASE WHEN i = 2 THEN 'code' WHEN i = 6 THEN 'table' ELSE 'text' END kind,
    CASE i WHEN 0 THEN 'Run this:' WHEN 1 THEN 'cd /tmp/' || lang WHEN 2 THEN 'plain ' || source WHEN 3 THEN CASE WHEN doc_id % 2 = 0 THEN 'SELECT ' || doc_id ELSE 'Then wait.' END
      WHEN 4 THEN CASE WHEN doc_id % 3 = 0 THEN 'Done.' ELSE 'export A=' || doc_id || chr(10) || 'set B' END WHEN 5 THEN '<config>' ELSE 'set in a table' END AS text FROM given)"""


@query(f"""WITH {_CODE}, told AS (SELECT *, kind = 'code' OR (kind = 'text' AND regexp_matches(text, '^(cd|SELECT|export|<config>)')) AS code FROM blocks),
runs AS (SELECT *, sum(CASE WHEN code AND before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) run FROM (SELECT *, coalesce(lag(code) OVER (PARTITION BY doc_id ORDER BY i), false) before FROM told))
SELECT doc_id AS section_id, min(i) ordinal, CASE WHEN bool_or(code) THEN 'code' ELSE min(kind) END AS kind, string_agg(text, chr(10) ORDER BY i) AS text, 1 + min(i) // 2 AS page_start, 1 + max(i) // 2 AS page_end FROM runs GROUP BY doc_id, run""")
def merge_code_blocks(spark, d):
    i, n = F.col("i"), F.col("doc_id")
    text = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    said = (F.lit("Run this:"), text("cd /tmp/", F.col("lang")), text("plain ", F.col("source")), F.when(n % 2 == 0, text("SELECT ", n)).otherwise("Then wait."), F.when(n % 3 == 0, "Done.").otherwise(text("export A=", n, "\nset B")), F.lit("<config>"), F.lit("set in a table"))
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.array(*said)).alias("i", "text"))
    page = (1 + F.floor(i / 2)).cast("int")
    blocks = rows.select(n.alias("section_id"), i.alias("ordinal"), F.when(i == 2, "code").when(i == 6, "table").otherwise("text").alias("kind"), "text", page.alias("page_start"), page.alias("page_end"))
    return chunking.merge_commands(blocks)


def document_chunks(spark: SparkSession, d: str, docs: DataFrame | None = None) -> DataFrame:
    """Chunks of every document, or of docs, each line a text block, 20 lines to a page."""
    blocks = D.lines(spark, d, docs).where("trim(line) <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line", "page"))).alias("b"))
    sections = blocks.select(F.concat(F.col("doc_id").cast("string"), F.lit("#0")).alias("section_id"), F.lit("Document").alias("header"), F.transform("b", lambda b: F.struct(F.lit("text").alias("kind"), b["line"].alias("text"), b["page"].alias("page_start"), b["page"].alias("page_end"))).alias("blocks"))
    return chunking.chunk_sections(sections)


@query()
def chunk_pack(spark, d):
    return document_chunks(spark, d).select("chunk_id", "content_type", "page_start", "page_end", "token_count", F.length("text").alias("n_chars"))




_UNITS = """WITH RECURSIVE units AS (SELECT doc_id, i::INT i, n FROM (SELECT doc_id, unnest(range(len(u))) i, unnest(u) n FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: len(list_filter(string_split_regex(x, '[\\s]+'), lambda w: w <> ''))), lambda n: n > 0) u FROM documents))),
  p AS (SELECT doc_id, 0 i, n, 0 g FROM units WHERE i = 0 UNION ALL SELECT u.doc_id, u.i, CASE WHEN p.n + u.n > 50 THEN u.n ELSE p.n + u.n END, CASE WHEN p.n + u.n > 50 THEN p.g + 1 ELSE p.g END FROM p JOIN units u ON u.doc_id = p.doc_id AND u.i = p.i + 1)
SELECT doc_id, g AS piece, sum(units.n)::INT AS words FROM p JOIN units USING (doc_id, i) GROUP BY ALL"""


@query(_UNITS)
def pack_units(spark, d):
    lines = F.filter(F.split("text", "\n"), lambda x: X.count_words(x) > 0)
    pieces = table(spark, d, "documents").select("doc_id", F.posexplode(chunking.pack(lines, "\n", limit=50)).alias("piece", "t"))
    return pieces.select("doc_id", "piece", X.count_words(F.col("t")).alias("words"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Slide' || CASE WHEN doc_id % 4 = 0 THEN ' 2' ELSE 's 2-' || (2 + doc_id % 4) END || ': ' || source WHEN doc_id % 5 = 0 THEN source ELSE (doc_id % 5) || '.1 ' || source END AS label,
  lang || CASE WHEN lo = 0 AND hi = 9999 THEN '' WHEN hi = 9999 THEN ' [R' || lo || 'x+]' WHEN lo = hi THEN ' [R' || lo || 'x]' WHEN lo = 0 THEN ' [up to R' || hi || 'x]' ELSE ' [R' || lo || 'x-R' || hi || 'x]' END || ' > ' AS prefix
FROM (SELECT *, CASE WHEN doc_id % 7 < 2 THEN 0 ELSE 2015 + doc_id % 5 END lo, CASE WHEN doc_id % 2 = 0 OR doc_id % 7 < 2 THEN 9999 WHEN doc_id % 7 = 2 THEN 2015 + doc_id % 5 ELSE 2022 END hi FROM documents)""")
def section_labels(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "documents").withColumn("lo", F.when(i % 7 < 2, 0).otherwise((2015 + i % 5).cast("int"))).withColumn("hi", F.when((i % 2 == 0) | (i % 7 < 2), 9999).when(i % 7 == 2, (2015 + i % 5).cast("int")).otherwise(2022))
    number = F.when(i % 5 == 0, "0").otherwise(F.concat((i % 5).cast("string"), F.lit(".1")))
    label = chunking.section_label(number, F.col("source"), F.lit(2), (2 + i % 4).cast("int"), F.when(i % 3 == 0, "pptx").otherwise("pdf"))
    return rows.select("doc_id", label.alias("label"), chunking.header_prefix(F.col("lang"), F.col("lo"), F.col("hi")).alias("prefix"))


@query("SELECT doc_id, doc_id % 4 < 2 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS fresh FROM documents")
def chunks_up_to_date(spark, d):
    i = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", F.when(i % 4 == 0, "chunked").when(i % 4 == 1, "indexed").otherwise("parsed").alias("status"), F.when(i % 3 == 0, 0).otherwise(1).alias("chunker_version"), F.lit(1).alias("chunk_count"), F.concat_ws(" ", F.lit("Title"), F.col("lang")).alias("prefix"))
    chunks = table(spark, d, "documents").select("doc_id", F.lit(0).alias("ordinal"), F.concat(F.when(i % 5 == 0, "Old").otherwise("Title"), F.lit(" "), F.col("lang"), F.lit(" > 1")).alias("header"))
    return chunking.up_to_date(docs, chunks)


@query(f"WITH h AS (SELECT doc_id, sha1('{NAMESPACE.replace('-', '')}') x FROM documents), i AS (SELECT doc_id, sha1(unhex('{NAMESPACE.replace('-', '')}') || encode(doc_id::VARCHAR || '#0#0')) h FROM documents) SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1)::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM i")
def point_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", X.point_id(F.concat(F.col("doc_id").cast("string"), F.lit("#0#0")), NAMESPACE).alias("point_id"))


@query(f"SELECT doc_id, substr(sha256({D.marked('doc_id')} || {D.marked('lang')} || {D.marked('source')}), 1, 16) AS hash FROM documents")
def metadata_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", oplog.metadata_hash("doc_id", "lang", "source").alias("hash"))


@query(f"WITH h AS (SELECT sha256({D.marked('doc_id')} || {D.marked('lang')}) s FROM documents) SELECT substr(sha256(concat_ws('-', count(*)::VARCHAR, sum(('0x' || substr(s, 1, 8))::BIGINT)::VARCHAR, sum(('0x' || substr(s, 9, 8))::BIGINT)::VARCHAR, sum(('0x' || substr(s, 17, 8))::BIGINT)::VARCHAR, sum(('0x' || substr(s, 25, 8))::BIGINT)::VARCHAR)), 1, 16) AS fingerprint, count(*) n FROM h")
def corpus_fingerprint(spark, d):
    return oplog.fingerprint(table(spark, d, "documents"), "doc_id", "lang")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'not_chunked' WHEN doc_id % 5 = 1 OR doc_id % 3 = 0 THEN 'indexed' WHEN doc_id % 2 = 0 THEN 'metadata' ELSE 'skipped' END AS action FROM documents")
def index_actions(spark, d):
    i = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", F.when(i % 5 == 0, "parsed").when(i % 5 == 1, "chunked").otherwise("indexed").alias("status"), F.when(i % 3 == 0, "v0").otherwise("v1").alias("index_version"), F.lit("v1").alias("wanted_version"), F.when(i % 2 == 0, "old").otherwise("new").alias("metadata_hash"), F.lit("new").alias("new_hash"))
    return oplog.index_action(docs)


@query("""SELECT coalesce(o.doc_id, n.doc_id) doc_id, CASE WHEN n.doc_id IS NULL THEN 'indexed' WHEN o.doc_id IS NOT NULL AND n.doc_id % 6 <> 0 AND n.doc_id % 4 <> 0 THEN 'indexed' WHEN n.doc_id % 4 = 0 THEN 'failed' ELSE 'parsed' END AS status,
CASE WHEN n.doc_id IS NULL THEN o.h WHEN n.doc_id % 6 = 0 THEN md5('new') ELSE n.h END file_hash, CASE WHEN n.doc_id IS NOT NULL AND n.doc_id % 5 <> 0 THEN 2 WHEN o.doc_id IS NOT NULL THEN 1 END page_count, CASE WHEN n.doc_id % 4 = 0 THEN 'bad file' END error
FROM (SELECT doc_id, md5(text) h FROM documents WHERE lang <> 'fr') o FULL JOIN (SELECT doc_id, md5(text) h FROM documents WHERE source <> 'src0') n USING (doc_id)""")
def upsert_document(spark, d):
    i = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"), "lang", "source")
    stored = docs.where("lang <> 'fr'").select("doc_id", F.lit("indexed").alias("status"), F.col("h").alias("file_hash"), F.lit(1).alias("page_count"), F.lit(1.0).alias("parse_seconds"), F.lit("old").alias("error"))
    new = docs.where("source <> 'src0'").select("doc_id", F.when(i % 4 == 0, "failed").otherwise("parsed").alias("status"), F.when(i % 6 == 0, F.md5(F.lit("new"))).otherwise(F.col("h")).alias("file_hash"), F.when(i % 5 == 0, None).otherwise(2).alias("page_count"), F.lit(None).cast("double").alias("parse_seconds"), F.when(i % 4 == 0, "bad file").alias("error"))
    made = oplog.record_documents(stored, new)
    return made.select("doc_id", "status", "file_hash", "page_count", F.when(F.col("error") != "old", F.col("error")).alias("error"))


@query("SELECT d.doc_id FROM documents d JOIN (SELECT DISTINCT doc_id FROM labels) USING (doc_id)")
def prune_removed(spark, d):
    return oplog.prune(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"))


@query("SELECT doc_id, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END)::BIGINT headings, sum(CASE WHEN kind = 'list' THEN 1 ELSE 0 END)::BIGINT items, max(page) pages, count(DISTINCT page) pages_with_text FROM elements GROUP BY doc_id".join([f"WITH {D.ELEMENTS} ", ""]))
def document_stats(spark, d):
    e = D.elements(spark, d)
    return e.groupBy("doc_id").agg(F.count_if(F.col("kind") == "heading").alias("headings"), F.count_if(F.col("kind") == "list").alias("items"), F.max("page").alias("pages"), F.countDistinct("page").alias("pages_with_text"))


@query(f"WITH {D.LINES} SELECT doc_id, pos, last_value(CASE WHEN pos % 3 = 0 THEN page END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS page FROM lines")
def carried_pages(spark, d):
    rows = D.lines(spark, d).select("doc_id", F.col("pos").alias("ordinal"), F.when(F.col("pos") % 3 == 0, F.col("page")).alias("page"))
    return structure.carried_pages(rows).select("doc_id", F.col("ordinal").alias("pos"), "page")
