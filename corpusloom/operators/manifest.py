"""Manifest rows: validation with all errors at once, revision lineage, drafts for new files, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as X
from corpusloom.functions.joins import salted_join
from corpusloom.functions.tables import cut, ranked

# The manifest's header, its older form, and the file types that are read.
LEGACY_COLUMNS = ("doc_id", "path", "title", "family", "version", "release_min", "release_max", "allowed_groups", "external_ok", "category")
COLUMNS = (*LEGACY_COLUMNS, "added", "review")
PARSED_FORMATS = {"pdf": "pdf", "pptx": "pptx", "ppt": "pptx", "docx": "docx", "doc": "docx"}


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def doc_type(path: Column) -> Column:
    """The format a file is parsed as; null for a type that is not read."""
    made = F.lit(None).cast("string")
    for ending, kind in PARSED_FORMATS.items():
        made = F.when(suffix(path) == ending, kind).otherwise(made)
    return made


def validate(rows: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """rows (line, and the manifest's columns as text) with parsed columns and `errors`, an array of all messages.

    files: path of each file there is; without it no file is missed.
    """
    rows = rows.select("line", *(F.coalesce(F.col(c), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in COLUMNS))
    if files is not None:
        rows = rows.join(files.select(F.col("path").alias("_file")).distinct(), X.strip(F.col("path")) == F.col("_file"), "left")
    else:
        rows = rows.withColumn("_file", F.col("path"))
    t = {c: X.strip(F.col(c)) for c in COLUMNS}
    q = lambda c: F.concat(F.lit("'"), t[c], F.lit("'"))
    groups = F.filter(F.transform(F.split("allowed_groups", ";"), X.strip), lambda g: g != "")
    low = F.when(t["release_min"] == "", F.lit(X.RELEASE_ANY_MIN)).otherwise(X.release_year(F.col("release_min")))
    high = F.when(t["release_max"] == "", F.lit(X.RELEASE_ANY_MAX)).otherwise(X.release_year(F.col("release_max")))
    external = F.when(F.lower(t["external_ok"]).isin("true", "yes", "1"), True).when(F.lower(t["external_ok"]).isin("false", "no", "0"), False)
    added = X.iso_date(F.col("added"))
    said = lambda when, *parts: F.when(when, F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts)))
    one = F.array(
        said(~t["doc_id"].rlike("^[a-z0-9][a-z0-9-]*$"), "doc_id ", q("doc_id"), " must be a lowercase slug"),
        F.when(t["path"] == "", "path is empty").when(doc_type(t["path"]).isNull(), F.concat(F.lit("unsupported file type '"), suffix(t["path"]), F.lit("'"))).when(F.col("_file").isNull(), F.concat(F.lit("file not found: "), t["path"])),
        said(t["title"] == "", "title is empty"),
        said(~t["version"].rlike(r"^\d+(\.\d+)*$"), "version ", q("version"), " must look like 1.0 or 3.2"),
        said(low.isNull(), "invalid release ", q("release_min")),
        said(low.isNotNull() & high.isNull(), "invalid release ", q("release_max")),
        said(low > high, "release_min ", t["release_min"], " is after release_max ", t["release_max"]),
        said(F.size(groups) == 0, "allowed_groups is empty"),
        said(external.isNull(), "external_ok ", q("external_ok"), " must be true or false"),
        said(~t["category"].isin(*X.CATEGORIES), "category ", q("category"), " is not known"),
        said(added.isNull(), "added ", q("added"), " must be a date"),
    )
    bad = F.transform(F.filter(groups, lambda g: ~g.rlike("^[a-z0-9][a-z0-9_-]*$")), lambda g: F.concat(F.lit("group '"), g, F.lit("' must be lowercase")))
    return rows.where(F.concat_ws("", *COLUMNS) != "").select(
        "line", t["doc_id"].alias("doc_id"), t["path"].alias("path"), t["title"].alias("title"), F.when(t["family"] == "", t["doc_id"]).otherwise(t["family"]).alias("family"), t["version"].alias("version"),
        low.alias("release_min"), high.alias("release_max"), groups.alias("allowed_groups"), external.alias("external_ok"), t["category"].alias("category"), doc_type(t["path"]).alias("doc_type"),
        added.alias("added"), t["review"].alias("review"), F.concat(F.array_compact(one), bad).alias("errors"),
    )


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Every row but the first (by line) of its key, with first_line.

    The firsts are a partial aggregate, not a sort of each key's rows; only keys with several rows
    are joined back, and a large one in several places.
    """
    first = rows.groupBy(key).agg(F.min("line").alias("first_line"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return salted_join(rows, first, [key]).where(F.col("line") > F.col("first_line"))


def listing(valid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that are listed, and errors (line, message): ids first, then paths among those that are left."""
    ids = duplicates(valid, "doc_id")
    left = valid.join(ids.select("line"), "line", "left_anti")
    paths = duplicates(left, "path")
    errors = ids.select("line", F.concat(F.lit("duplicate doc_id '"), "doc_id", F.lit("' (first on line "), F.col("first_line").cast("string"), F.lit(")")).alias("message")).unionByName(
        paths.select("line", F.concat(F.lit("file already listed on line "), F.col("first_line").cast("string")).alias("message"))
    )
    return left.join(paths.select("line"), "line", "left_anti"), errors


def with_latest(listed: DataFrame) -> DataFrame:
    """listed with is_latest: the version is its family's highest, compared number by number."""
    key = X.version_key(F.col("version"))
    top = listed.groupBy("family").agg(F.max(key).alias("_top"))
    return salted_join(listed, top, ["family"]).withColumn("is_latest", key == F.col("_top")).drop("_top")


def version_clashes(listed: DataFrame) -> DataFrame:
    """line, family, version, first_line of rows whose family has that version on an earlier line."""
    keyed = listed.withColumn("_k", F.to_json(F.struct("family", X.version_key(F.col("version")))))
    return duplicates(keyed, "_k").select("line", "family", "version", "first_line")


def unlisted(files: DataFrame, listed: DataFrame) -> DataFrame:
    """Files of a type that is read, without a row."""
    return files.where(doc_type(F.col("path")).isNotNull()).join(listed.select("path"), "path", "left_anti")


def content_copies(files: DataFrame, listed: DataFrame) -> DataFrame:
    """path, copy_of of new files (path, content_hash) whose content is listed or repeats an earlier new file."""
    known = listed.groupBy("content_hash").agg(F.min("doc_id").alias("_id"))
    first = files.join(listed.select("path"), "path", "left_anti").groupBy("content_hash").agg(F.min("path").alias("_first"))
    new = files.join(listed.select("path"), "path", "left_anti").join(known, "content_hash", "left").join(first, "content_hash")
    of = F.when(F.col("_id").isNotNull(), F.concat(F.lit("manifest doc_id '"), F.col("_id").cast("string"), F.lit("'"))).when(F.col("path") > F.col("_first"), F.concat(F.lit("new file '"), "_first", F.lit("'")))
    return new.select("path", of.alias("copy_of")).where("copy_of is not null")


def draft(files: DataFrame) -> DataFrame:
    """A best-guess row for each new file (path, cover), every guess noted in review."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/\\]+)$", 1), r"\.[^.]*$", "")
    files = files.withColumn("_stem", stem).withColumn("_base", X.name_base(F.col("_stem"))).withColumn("_version", X.name_version(F.col("_stem")))
    files = files.withColumn("_named", X.releases_named(F.col("_base"))).withColumn("_cover", X.releases_named(F.coalesce("cover", F.lit(""))))
    r = lambda y: F.concat(F.lit("R"), y.cast("string"), F.lit("x"))
    several = lambda ys: F.array_join(F.transform(ys, r), ", ")
    named, cover, family = F.col("_named"), F.col("_cover"), F.when(X.slug(F.col("_base")) == "", "document").otherwise(X.slug(F.col("_base")))
    low = F.when(F.size(named) > 0, r(F.array_min(named))).when(F.size(cover) == 1, r(F.get(cover, F.lit(0)))).otherwise("")
    notes = F.array(
        F.when(F.size(named) > 0, F.concat(F.lit("release from the name: "), r(F.array_min(named)), F.lit(" onwards"))),
        F.when(F.size(named) > 1, F.concat(F.lit("several releases in the name ("), several(named), F.lit("): check the range"))),
        F.when((F.size(named) == 0) & (F.size(cover) == 1), F.concat(F.lit("release from the first pages: "), r(F.get(cover, F.lit(0))), F.lit(" onwards"))),
        F.when((F.size(named) == 0) & (F.size(cover) > 1), F.concat(F.lit("first pages name "), several(cover), F.lit(": set the release range"))),
        F.lit("category guessed from the name"),
    )
    return files.select(
        F.when(F.col("_version").isNotNull(), F.concat(family, F.lit("-v"), F.replace("_version", F.lit("."), F.lit("-")))).otherwise(family).alias("doc_id"),
        "path", F.trim(F.regexp_replace("_stem", "_+", " ")).alias("title"), family.alias("family"), F.coalesce("_version", F.lit("1.0")).alias("version"), low.alias("release_min"), F.lit("").alias("release_max"),
        F.lit("all").alias("allowed_groups"), F.lit("false").alias("external_ok"), X.guess_category(F.col("path")).alias("category"), F.array_join(F.array_compact(notes), "; ").alias("review"), F.col("_version").isNotNull().alias("named_version"),
    )


def resolve_families(drafts: DataFrame, listed: DataFrame) -> DataFrame:
    """drafts with families settled so that no listed document stops being the latest: own_family, version, note.

    A named version the family has, an unversioned file of a listed family, and a second unversioned
    one get a family of their own; the first unversioned one beside named versions is the newest. First
    is the one in a folder of a named version, then the one whose path comes first. A family whose
    name goes on where a listed one of 50 characters or more ends is noted. All is told by joins with
    what families have, one row each, so that a large family stays spread.
    """
    key = X.version_key(F.col("version"))
    mark = lambda df, *c: df.select(*c).distinct()
    d = drafts.withColumn("_folder", F.regexp_replace("path", "/?[^/]*$", "")).withColumn("_key", F.to_json(key))
    named = d.where("named_version")
    d = salted_join(d, mark(listed, "family").withColumn("_known", F.lit(True)), ["family"], "left")
    d = salted_join(d, mark(listed, "family", F.to_json(key).alias("_key")).withColumn("_has", F.lit(True)), ["family", "_key"], "left")
    d = salted_join(d, mark(named, "family", "_folder").withColumn("_beside", F.lit(True)), ["family", "_folder"], "left")
    d = salted_join(d, named.groupBy("family").agg(F.max(F.get(key, F.lit(0))).alias("_major")), ["family"], "left")
    d = d.withColumn("_turn", F.struct(F.col("_beside").isNull().alias("apart"), "path"))
    d = salted_join(d, d.where("not named_version").groupBy("family").agg(F.min("_turn").alias("_first")), ["family"], "left")
    starts = d.select("path", "family", F.explode(F.expr("transform(sequence(50, greatest(length(family) - 1, 50)), n -> substring(family, 1, n))")).alias("start")).where("start <> family")
    longer = starts.join(mark(listed, F.col("family").alias("start")), "start").groupBy("path").agg(F.min("start").alias("_shorter"))
    d = d.join(longer, "path", "left")
    plain, known, first = ~F.col("named_version"), F.col("_known").isNotNull(), F.col("_turn") == F.col("_first")
    clash = F.col("named_version") & F.col("_has").isNotNull()
    own = clash | (plain & (known | ~first))
    newest = plain & ~known & first & F.col("_major").isNotNull()
    note = (
        F.when(clash, "the family has this version: own family drafted")
        .when(plain & known, "same name as a listed family: own family drafted")
        .when(newest, "version guessed: newest")
        .when(plain & ~first, "same name as another new file: own family drafted")
    )
    revision = F.when(F.col("_shorter").isNotNull(), F.concat(F.lit("may be a revision of family '"), "_shorter", F.lit("'")))
    notes = F.array_compact(F.array(note, revision))
    return d.select("path", "doc_id", "family", own.alias("own_family"), F.when(newest, F.concat((F.col("_major") + 1).cast("string"), F.lit(".0"))).otherwise(F.col("version")).alias("version"), F.when(F.size(notes) > 0, F.array_join(notes, "; ")).alias("note"))


def scan(files: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drafted rows of the files that the manifest lacks, and the copies (path, copy_of) that get none.

    files(path, content_hash, cover), all there are; listed(path, doc_id, family, version, content_hash),
    the manifest with the contents of its files. A file whose content is listed, or that an earlier
    new file has, is a copy. Families are settled among all drafts; then ids are given, first to the
    drafts that keep their family, so that what is given in one step is taken in the next, and a
    draft with a family of its own gets its id as the family. Nothing is written.
    """
    new = unlisted(files, listed)
    copies = cut(content_copies(new, listed))
    drafts = cut(draft(new.join(copies.select("path"), "path", "left_anti")))
    settled = cut(resolve_families(drafts, listed))
    ids = unique_ids(settled.select("path", "doc_id", F.col("own_family").alias("split")), listed).withColumnRenamed("doc_id", "_id")
    kept = drafts.drop("doc_id", "family", "version", "named_version").join(settled.select("path", "family", "own_family", "version", "note"), "path").join(ids, "path")
    family = F.when(F.col("own_family"), F.col("_id")).otherwise(F.col("family"))
    review = F.concat_ws("; ", F.nullif("review", F.lit("")), "note")
    rows = kept.select(F.col("_id").alias("doc_id"), "path", "title", family.alias("family"), "version", "release_min", "release_max", "allowed_groups", "external_ok", "category", review.alias("review"))
    return rows, copies


def unique_ids(drafts: DataFrame, taken: DataFrame) -> DataFrame:
    """path, doc_id: ids as drafts(path, doc_id[, split]) would get them one after the other, those to be split last, by the parts of their paths.

    A draft takes the id it wants; if that is taken (in `taken`, or by a draft before it), its folder's
    name and that; if that is taken too, the id it wants cut to 56 characters and the first free number
    from 2 on. All drafts ask at once, and of those that ask for one id the first has it; those that
    lose ask for their next one. Numbers are not tried one by one: the k-th draft that numbers a base
    has the k-th number that no taken id of the base fills. So a round settles a base whatever its
    size, and there are about as many rounds as steps in the longest chain of drafts that displace
    each other. No draft's folder is no second wish; a null id is no wish and the draft is left out.
    """
    split = F.col("split") if "split" in drafts.columns else F.lit(False)
    parent = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    second = F.when(parent != "", F.regexp_replace(F.substring(F.concat_ws("-", parent, "doc_id"), 1, 60), "-+$", ""))
    wishes = drafts.where("doc_id is not null").select("path", F.struct(split.alias("split"), F.split("path", "/").alias("parts")).alias("turn"), F.col("doc_id").alias("w0"), second.alias("w1"), F.substring("doc_id", 1, 56).alias("base"))
    used = taken.select(F.col("doc_id").alias("id")).where("id is not null").distinct()
    for w in ("w0", "w1"):
        wishes = wishes.join(used.select(F.col("id").alias(w), F.lit(True).alias(f"{w}_used")), w, "left")
    open1 = F.col("w1").isNotNull() & F.col("w1_used").isNull()
    state = cut(wishes.select("path", "turn", "w0", "w1", "base", open1.alias("open1"), F.when(F.col("w0_used").isNull(), 0).when(open1, 1).otherwise(2).alias("step")))
    number = F.regexp_extract("id", "^.*-([1-9][0-9]{0,17})$", 1)
    filled = used.where(number != "").select(F.regexp_extract("id", "^(.*)-[0-9]+$", 1).alias("base"), number.cast("long").alias("n")).where("n >= 2")
    filled = cut(filled.join(state.select("base").distinct(), "base", "left_semi"))
    barred = None  # numbers that a draft before holds as one of its wishes
    while True:
        tail = _numbered(state.where("step = 2"), filled if barred is None else filled.unionByName(barred.select("base", "n")).distinct())
        asked = state.where("step < 2").select("path", "turn", F.when(F.col("step") == 0, F.col("w0")).otherwise(F.col("w1")).alias("id"), "step", "base", F.lit(None).cast("long").alias("n"))
        asked = asked.unionByName(tail.select("path", "turn", F.concat_ws("-", "base", F.col("n").cast("string")).alias("id"), F.lit(2).alias("step"), "base", "n"))
        first = asked.groupBy("id").agg(F.min(F.struct("turn", "step")).alias("first"))
        now = cut(salted_join(asked, first, ["id"]).withColumn("won", F.col("turn") == F.col("first.turn")))
        held = now.where("won and step < 2").select("id", F.col("turn").alias("held_by"))
        # a number lost to a wish is barred, until a draft before the one that holds it comes to need it
        lost = now.where("not won and step = 2").select("base", "n")
        again = (lost if barred is None else barred.select("base", "n").union(lost)).distinct()
        bars = again.withColumn("id", F.concat_ws("-", "base", F.col("n").cast("string"))).join(held, "id").select("base", "n", "held_by")
        rows = bars.select("base", "n", "held_by", F.lit(None).cast(state.schema["turn"].dataType).alias("turn")).unionByName(now.where("step = 2").select("base", "n", F.lit(None).cast(state.schema["turn"].dataType).alias("held_by"), "turn"))
        earliest = F.min("turn").over(Window.partitionBy("base").orderBy(F.desc("n")))  # of the drafts with this number or a higher one
        kept = cut(rows.withColumn("_e", earliest).where("held_by is not null and (_e is null or _e > held_by)").select("base", "n"))
        losers = now.where("not won and step < 2").select("path", F.lit(1).alias("_lost"))
        same = barred is not None and not kept.exceptAll(barred).union(barred.exceptAll(kept)).limit(1).count() or barred is None and kept.isEmpty()
        if same and now.where("not won").isEmpty():
            return now.select("path", F.col("id").alias("doc_id"))
        further = F.when(F.col("_lost").isNull(), F.col("step")).when((F.col("step") == 0) & F.col("open1"), 1).otherwise(2)
        state, barred = cut(state.join(losers, "path", "left").withColumn("step", further).drop("_lost")), kept


def _numbered(drafts: DataFrame, filled: DataFrame) -> DataFrame:
    """drafts(path, turn, base) with n: the k-th draft of a base, by turn, has the k-th number from 2 on that filled(base, n) lacks.

    Before the j-th filled number f there are f - 1 - j free ones. The numbers filled before the k-th
    free one are those with fewer than k before them, and where k falls among these tells how many.
    """
    mine = ranked(drafts.select("path", "turn", "base"), ["base"], [F.col("turn")], "k")
    holes = ranked(filled, ["base"], [F.col("n")], "j").select("base", (F.col("n") - 1 - F.col("j")).alias("k"), F.lit(None).cast("string").alias("path"), F.lit(None).cast(drafts.schema["turn"].dataType).alias("turn"), F.lit(1).alias("kind"))
    both = holes.unionByName(mine.withColumn("kind", F.lit(0)))
    # a hole with as many free numbers before it as k comes after the k-th draft
    among = ranked(both, ["base"], [F.col("k"), F.col("kind"), F.col("turn")], "place")
    return among.where("kind = 0").select("path", "turn", "base", (F.col("place") + 1).alias("n"))


def backfill(rows: DataFrame) -> DataFrame:
    """rows (doc_id, path, added, release_min, release_max, review, file_date, cover) with blanks filled and `changes`."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/\\]+)$", 1), r"\.[^.]*$", "")
    named, cover = X.releases_named(X.name_base(stem)), X.releases_named(F.coalesce("cover", F.lit("")))
    r = lambda y: F.concat(F.lit("R"), y.cast("string"), F.lit("x"))
    blank = (X.strip(F.col("release_min")) == "") & (X.strip(F.col("release_max")) == "")
    from_name, from_cover = blank & (F.size(named) > 0), blank & (F.size(named) == 0) & (F.size(cover) == 1)
    dated = (F.col("added") == "") & (F.coalesce("file_date", F.lit("")) != "")
    changes = F.array_compact(F.array(F.when(dated, F.concat(F.lit("added = "), "file_date")), F.when(from_name, F.concat(F.lit("release "), r(F.array_min(named)), F.lit("+ (from the name)"))), F.when(from_cover, F.concat(F.lit("release "), r(F.get(cover, F.lit(0))), F.lit("+ (from the first pages)")))))
    return rows.select("doc_id", F.when(dated, F.col("file_date")).otherwise(F.col("added")).alias("added"), F.when(from_name, r(F.array_min(named))).when(from_cover, r(F.get(cover, F.lit(0)))).otherwise(F.col("release_min")).alias("release_min"), changes.alias("changes"))


def by_folder(files: DataFrame) -> DataFrame:
    return files.groupBy(F.coalesce(F.nullif(F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.lit("")), F.lit(".")).alias("folder")).agg(F.count("*").alias("files"))


def reconcile(stored: DataFrame, listed: DataFrame) -> DataFrame:
    """doc_id, state: ok, not parsed (only listed) or not listed (only stored)."""
    both = stored.select("doc_id", "status").join(listed.select("doc_id", F.lit(True).alias("_l")), "doc_id", "full_outer")
    return both.select("doc_id", F.when(F.col("status").isNull(), "not parsed").when(F.col("_l").isNull(), "not listed").otherwise(F.col("status")).alias("state"))
