"""Queries over tracks, listings, compositions and lyrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ragaloom import jobs, service
from ragaloom.functions import text
from ragaloom.ml import raga
from ragaloom.operators import catalog, evaluate, ranks, tala
from ragaloom.session import table



def _t(name):
    return lambda spark, d: table(spark, d, name)


tracks, scraped, works, lyrics, vocab = (_t(n) for n in ("tracks_meta", "scraped_compositions", "compositions", "lyrics_catalog", "raga_vocab"))


def s04_tracks(spark, d):
    return tracks(spark, d).select("track_id", "key", "title", "tonic", "raga")


def s07_usable_tracks(spark, d):
    c = table(spark, d, "composition_catalog_contours").filter("contour is not null").select("track_id")
    return tracks(spark, d).filter("title <> '' and tonic > 0").join(c, "track_id", "left_semi").select("row_id", "track_id", "title", F.round("tonic", 6).alias("tonic"))


def s08_bundle(spark, d):
    c = table(spark, d, "composition_catalog_contours").select("track_id")
    return tracks(spark, d).join(c, "track_id", "left_semi").filter("tonic > 0").select("row_id", "track_id", F.coalesce(F.expr("nullif(title, '')"), "track_id").alias("title"), F.coalesce("raga", F.lit("")).alias("raga"))


def s09_track_index(spark, d):
    """Tracks that have a tonic, be it 0, and a contour; a title that is missing is the id, one that is empty stays."""
    c = table(spark, d, "composition_catalog_contours").select("track_id")
    return tracks(spark, d).join(c, "track_id", "left_semi").filter("tonic is not null").select("row_id", "track_id", F.coalesce("title", "track_id").alias("title"), F.coalesce("raga", F.lit("")).alias("raga"))


def s07_skipped(spark, d):
    """Tracks in all, those with contour, title and tonic, and those that a catalog would skip."""
    c = table(spark, d, "composition_catalog_contours").select("track_id", F.col("contour").alias("frequencies"))
    _, told = jobs.usable(tracks(spark, d).select("track_id", "title", "tonic").join(c, "track_id", "left"))
    return spark.createDataFrame([tuple(told.values())], "total long, usable long, skipped long")


def f16_joined(spark, d):
    """Where a link on a page leads, by its own address."""
    return scraped(spark, d).select("row_id", text.joined_url(F.col("source_url"), F.lit("c12.shtml")).alias("url"))


def s12_training_scan(spark, d):
    return tracks(spark, d).filter("raga <> ''").select("row_id", "raga", F.round(F.coalesce(F.when(F.col("tonic") != 0, F.col("tonic")), F.lit(220.0)), 6).alias("tonic"))


def s23_vocabulary(spark, d):
    names = vocab(spark, d).select(F.col("raga_name").alias("name"))
    used = tracks(spark, d).filter("raga <> ''").select(F.col("raga").alias("name")).distinct()
    out = names.join(used, "name", "left_semi").distinct()
    return out.withColumn("rank", F.row_number().over(Window.orderBy("name")))  # at most a vocabulary's rows


def s25_seeds(spark, d):
    new = scraped(spark, d).filter("trim(title) <> ''").select("row_id", "title", "raga")
    return catalog.inserted(lyrics(spark, d).select("title"), new, "title", "row_id").select("row_id", "title", "raga")


def sp06_by_raga(spark, d):
    """The tracks of a list of ragas, here the vocabulary's, by names without regard to case and space around them."""
    names = vocab(spark, d).select("raga_name")
    return catalog.by_names(tracks(spark, d), "raga", names).select("row_id", "raga")


def sp07_real_titles(spark, d):
    return scraped(spark, d).filter(text.is_composition(F.col("title"))).select("row_id")


def sp08_listing_lines(spark, d):
    line = F.concat_ws(" - ", "title", "raga")
    return scraped(spark, d).select("row_id", text.listing(line).alias("x")).filter("x is not null").select("row_id", "x.title", "x.raga")


def sp09_artist_pages(spark, d):
    return scraped(spark, d).filter(text.is_artist_page(F.col("source_url"), "concerts", "artist")).select("row_id")


def sp10_song_links(spark, d):
    return scraped(spark, d).select("row_id", text.is_song_link(F.col("source_url")).alias("song"))


def sp12_uncertain(spark, d):
    shares = scraped(spark, d).filter("raga_canonical <> ''").groupBy("artist", "raga_canonical").agg(F.count("*").alias("n"))
    top = shares.groupBy("artist").agg((F.max("n") / F.sum("n")).alias("top"))
    return top.select("artist", F.round("top", 6).alias("top"), F.coalesce(F.col("top") < 0.3, F.lit(True)).alias("uncertain"), F.when(F.col("top") < 0.5, "low").otherwise("fine").alias("label"))


def sp16_first_of_list(spark, d):
    verses = F.from_json("charanam", "array<string>")
    return works(spark, d).select("row_id", F.coalesce(F.get(verses, F.lit(0)), F.lit("")).alias("first"), F.size(verses).alias("n"))


def sp17_clean_batch(spark, d):
    return catalog.latest(scraped(spark, d).filter("trim(title) <> ''"), ["title"], "row_id").select("row_id", "title")


def sp20_labels(spark, d):
    twice = F.count("*").over(Window.partitionBy("title")) > 1
    return tracks(spark, d).filter("title is not null").select("row_id", F.when(twice, F.concat("title", F.lit(" ("), "track_id", F.lit(")"))).otherwise(F.col("title")).alias("label"))


def j04_lookup(spark, d):
    one = catalog.latest(tracks(spark, d), ["track_id"], F.desc("row_id")).select("track_id", "title", "raga")
    return table(spark, d, "composition_catalog_meta").select("row_id", "track_id").join(one, "track_id", "left")


def j06_aliases(spark, d):
    names = F.broadcast(vocab(spark, d).select(F.col("raga_name").alias("k"), "raga_id"))
    s = scraped(spark, d).withColumn("k", F.trim("raga"))
    return s.join(names, "k", "left").select("row_id", "raga", "raga_id")


def _index(spark, d):
    return catalog.fold_index(vocab(spark, d).select("raga_name", F.col("raga_id").alias("seq")), "raga_name")


def f10_fold_index(spark, d):
    return _index(spark, d)


HAND = [("unknown", None), ("encore", None), ("tuning", None), ("missing", None)]


def j07_resolved(spark, d):
    """The exact tiers: hand-made aliases (whose null stops the search), then the fold index."""
    hand = spark.createDataFrame(HAND, "key string, canonical string")
    return catalog.resolved(scraped(spark, d).select("raga"), hand, _index(spark, d), fuzzy=False)


def j08_resolved_fuzzy(spark, d):
    hand = spark.createDataFrame(HAND, "key string, canonical string")
    return catalog.resolved(scraped(spark, d).select("raga"), hand, _index(spark, d))


def j09_lyrics_of_match(spark, d):
    """Lyrics of compositions by exact title, else by the smallest title that contains the name."""
    wanted = works(spark, d).filter("composition_name <> ''").select("composition_name")
    return catalog.found_by_title(lyrics(spark, d), wanted)


def j11_meanings(spark, d):
    w = catalog.latest(works(spark, d), ["composition_id"], F.desc("row_id"))
    prompt = text.prompt(*[F.col(c) for c in ("composition_name", "composer", "raga", "tala", "language", "pallavi", "anupallavi")], F.from_json("charanam", "array<string>"))
    by_title = catalog.latest(lyrics(spark, d).filter("title is not null"), ["title"], F.desc("row_id")).select(F.col("title").alias("composition_name"), F.col("meaning_en").alias("meaning"))
    held = w.join(by_title, "composition_name").select("composition_id", "meaning")
    return catalog.meanings(w.select("composition_id", prompt.alias("prompt")), held, lambda p: p.split("\n")[0])


def j12_rendered_twice(spark, d):
    twice = tracks(spark, d).filter("title <> ''").groupBy("title").agg(F.countDistinct("track_id").alias("n")).filter("n >= 2")
    return tracks(spark, d).join(twice.select("title"), "title", "left_semi").select("row_id", "title")


def j13_missing(spark, d):
    return scraped(spark, d).filter("title <> ''").select("title").distinct().join(lyrics(spark, d).select("title"), "title", "left_anti")


def j14_tala_truth(spark, d):
    """A prediction (the commonest tala of the composer) against the annotation, by canonical names."""
    w = works(spark, d).filter("composer <> '' and tala <> ''").select("row_id", "composer", text.tala(F.col("tala")).alias("label"))
    common = catalog.latest(w.groupBy("composer", "label").agg(F.count("*").alias("n")), ["composer"], F.desc("n"), "label").select("composer", F.col("label").alias("prediction"))
    return w.join(common, "composer").select("row_id", "label", "prediction")


def a16_accuracy(spark, d):
    return evaluate.accuracy(j14_tala_truth(spark, d)).select("n", "correct", F.round("accuracy", 6).alias("accuracy"))


def j15_rendition_pairs(spark, d):
    one = catalog.latest(tracks(spark, d).filter("title <> ''"), ["track_id"], "row_id").select("title", "track_id", "row_id")
    w = Window.partitionBy("title").orderBy("row_id")
    ranked = one.select("title", "track_id", F.row_number().over(w).alias("r"), F.first("track_id").over(w).alias("reference_id"))
    return ranked.filter("r > 1").select("title", "reference_id", F.col("track_id").alias("query_id"))


def a07_title_counts(spark, d):
    return scraped(spark, d).groupBy("title").agg(F.count("*").alias("n"))


def k06_real_titles(spark, d):
    """The 30 commonest titles of compositions: a top-k report."""
    c = scraped(spark, d).filter(text.is_composition(F.col("title"))).groupBy("title").agg(F.count("*").alias("n"))
    return c.orderBy(F.desc("n"), "title").limit(30)


def k08_report(spark, d):
    """The 20 ragas with most tracks: a top-k report."""
    return tracks(spark, d).filter("raga <> ''").groupBy("raga").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "raga").limit(20)


def a09_repeated(spark, d):
    g = tracks(spark, d).filter("title <> ''").groupBy("title").agg(F.count("*").alias("n")).filter("n >= 2")
    return g.agg(F.count("*").alias("titles"), F.coalesce(F.sum("n"), F.lit(0)).alias("tracks"))


def _told(spark, d):
    names = vocab(spark, d).select(F.col("raga_name").alias("label"))
    return scraped(spark, d).select(F.col("raga").alias("label"), F.col("raga_canonical").alias("prediction")).join(F.broadcast(names), "label", "left_semi")


def a14_confusion(spark, d):
    return evaluate.confusion(_told(spark, d))


def a15_by_class(spark, d):
    return evaluate.by_class(_told(spark, d)).select("label", "n", F.round(F.coalesce("accuracy", F.lit(0.0)), 6).alias("accuracy"))


def a18_best(spark, d):
    return _told(spark, d).filter("prediction is not null").groupBy("label").agg(F.count("*").alias("n")).agg(F.max_by("label", F.struct("n", "label")).alias("label"), F.max("n").alias("n"))


def a19_mapped(spark, d):
    s = scraped(spark, d).filter("trim(raga) <> ''")
    return s.agg(F.countDistinct("raga").alias("spellings"), F.count_if(F.col("raga_canonical").isNotNull()).alias("mapped"), F.count("*").alias("n"), F.round(F.avg(F.col("raga_canonical").isNotNull().cast("double")), 6).alias("part"))


def a20_counts(spark, d):
    parts = [table(spark, d, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("tracks_meta", "compositions", "lyrics_catalog", "scraped_compositions")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def k04_ordered(spark, d):
    w = Window.partitionBy("composer").orderBy("composition_name", "row_id")
    return works(spark, d).select("row_id", "composer", F.row_number().over(w).alias("place"))


def u01_union(spark, d):
    a = tracks(spark, d).select("title", F.lit("tracks").alias("origin"))
    return a.unionByName(scraped(spark, d).select("title", F.lit("scrape").alias("origin")))


def u02_priority_union(spark, d):
    a = vocab(spark, d).select(F.col("raga_name").alias("name"), F.lit(0).alias("priority"))
    b = tracks(spark, d).filter("raga <> ''").select(F.col("raga").alias("name")).distinct()
    return a.unionByName(b.join(a.select("name"), "name", "left_anti").withColumn("priority", F.lit(1)))


def u03_distinct(spark, d):
    return works(spark, d).select("tala").distinct()


def u04_merged(spark, d):
    """Two maps of raga to composer, the later table's entry wins."""
    a = works(spark, d).filter("raga <> '' and composer <> ''").select("raga", "composer", "row_id", F.lit(0).alias("later"))
    b = lyrics(spark, d).filter("raga <> '' and composer <> ''").select("raga", "composer", "row_id", F.lit(1).alias("later"))
    return catalog.latest(a.unionByName(b), ["raga"], F.desc("later"), F.desc("row_id")).select("raga", "composer")


def w08_first_and_rest(spark, d):
    w = Window.partitionBy("title").orderBy("row_id")
    return scraped(spark, d).filter("title is not null").select("row_id", (F.row_number().over(w) == 1).alias("first"))


def w09_keys(spark, d):
    """Dense keys over all tracks, ranked in slices of row_id."""
    t = tracks(spark, d).select("row_id")
    return ranks.ranked(t, [], ranks.sliced(t, "row_id"), [F.col("row_id")]).select("row_id", F.concat(F.lit("t"), (F.col("rank") - 1).cast("string")).alias("key"))


def w13_sections(spark, d):
    verses = F.from_json("charanam", "array<string>")
    page = F.concat(F.array(F.lit("title line"), F.lit("Pallavi"), F.col("pallavi"), F.lit(" "), F.lit("ANUPALLAVI:"), F.col("anupallavi")), F.flatten(F.transform(verses, lambda v: F.array(F.lit("caraNam 1"), v))))
    lines = works(spark, d).select(F.col("row_id").alias("page_id"), F.posexplode(page).alias("line_no", "line"))
    return catalog.sections(lines).select("page_id", "pallavi", "anupallavi", F.array_join("charanam", "|").alias("charanam"))


def w14_failure_runs(spark, d):
    """The longest run of lyrics without a meaning in each language, by order of adding, and the runs of at least five,
    after each of which a batch would have stopped."""
    x = lyrics(spark, d).select("language", "meaning_en", "added_at", "row_id")
    found = ranks.runs(x, "language", ranks.sliced(x, "added_at"), [F.col("added_at"), F.col("row_id")], F.col("meaning_en").isNull())
    return found.groupBy("language").agg(F.max("n").alias("longest"), F.count_if(F.col("n") >= 5).alias("stops"))


def m01_upserted(spark, d):
    w = works(spark, d).select("composition_id", "composer", "raga", "updated_at", "row_id")
    order = (F.desc("updated_at"), F.desc("row_id"))
    held = catalog.latest(w.filter("row_id % 2 = 1"), ["composition_id"], *order)
    return catalog.upserted(held, w.filter("row_id % 2 = 0"), "composition_id", *order).select("composition_id", "composer", "raga", "row_id")


def m02_inserted(spark, d):
    new = scraped(spark, d).select("row_id", "title", "raga")
    return catalog.inserted(lyrics(spark, d).select("title"), new, "title", "row_id").agg(F.count("*").alias("n_added"))


def m03_updated(spark, d):
    held = lyrics(spark, d).select("row_id", "title", "meaning_en")
    changes = catalog.latest(scraped(spark, d).filter("title is not null"), ["title"], "row_id").select("title", F.concat(F.lit("set in "), F.coalesce("raga_canonical", F.lit("?"))).alias("meaning_en"))
    return catalog.updated(held, changes, "title", ["meaning_en"])


def m05_search(spark, d):
    out = None
    for column, part in (("composition_name", "MARUVA"), ("raga", "ji%ri"), ("composer", "n. ")):
        one = catalog.search(works(spark, d), column, part).select(F.lit(column).alias("field"), "row_id")
        out = one if out is None else out.unionByName(one)
    return out


def m04_point(spark, d):
    first = works(spark, d).agg(F.min("composition_id").alias("composition_id"))
    return works(spark, d).join(F.broadcast(first), "composition_id", "left_semi").select("row_id", "composition_id")


def m06_listed(spark, d):
    """All works in the order of composer and name, with the place of each."""
    w = catalog.latest(works(spark, d), ["composition_id"], F.desc("row_id")).select("composition_id", "composer", "composition_name")
    return catalog.listed(w, "composer", "composition_name", "composition_id")


def f07_tala(spark, d):
    return works(spark, d).select("row_id", text.tala(F.col("tala")).alias("tala"))


def f08_slug(spark, d):
    return works(spark, d).select("row_id", text.slug(F.col("composition_name"), F.col("composer")).alias("slug"))


def f09_fold(spark, d):
    return works(spark, d).select("row_id", text.fold(F.col("composer")).alias("folded"))


def f11_fields(spark, d):
    page = F.concat(F.lit("Song\nRaagam : "), "raga", F.lit("\nTAALAM:  "), "tala", F.lit(" \n"), "composer")
    return works(spark, d).select("row_id", text.field(page, "raagam").alias("raga"), text.field(page, "taalam").alias("tala"), text.field(page, "language").alias("language"))


def f12_language(spark, d):
    return works(spark, d).select("row_id", text.language(F.col("language")).alias("language"))


def f15_display(spark, d):
    return scraped(spark, d).select("row_id", text.display_name(F.get(text.path_parts(F.col("source_url")), F.lit(1))).alias("name"))


def f16_address(spark, d):
    return scraped(spark, d).select("row_id", F.parse_url("source_url", F.lit("HOST")).alias("host"), F.concat(F.lit("https://one.example"), F.parse_url("source_url", F.lit("PATH"))).alias("url"))


def f17_json(spark, d):
    v = F.from_json("charanam", "array<string>")
    return works(spark, d).select("row_id", F.size(v).alias("n"), F.to_json(v).alias("encoded"))


def f19_prompt(spark, d):
    cols = [F.col(c) for c in ("composition_name", "composer", "raga", "tala", "language", "pallavi", "anupallavi")]
    return works(spark, d).select("row_id", text.prompt(*cols, F.from_json("charanam", "array<string>")).alias("prompt"))


def f22_percent(spark, d):
    g = tracks(spark, d).groupBy("raga").agg(F.count("*").alias("n"))
    return g.select("raga", F.concat(F.format_number(F.col("n") / 7.0, 1), F.lit("%")).alias("shown"), F.concat(F.lpad(F.floor(F.col("n") / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("n") % 60).cast("string"), 2, "0")).alias("clock"))


def l01_labels(spark, d):
    """Codes of sorted distinct labels, ranked in slices of their first letters."""
    names = tracks(spark, d).filter("raga <> ''").select("raga").distinct()
    return ranks.ranked(names, [], ranks.by_letters(F.col("raga")), [F.col("raga")], "code").select("raga", (F.col("code") - 1).cast("int").alias("code"))


def l05_folds(spark, d):
    return raga.folds(table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id").select("vec_id", "fold")


def sp14_projection(spark, d):
    return service.list_tracks(tracks(spark, d))


def j05_zipped(spark, d):
    """Contours and titled tracks, each in the order of its ids, zipped by place."""
    c = table(spark, d, "composition_catalog_contours").select("track_id")
    m = table(spark, d, "composition_catalog_meta").select("track_id").dropna().distinct()

    def placed(df, name):
        return ranks.ranked(df, [], ranks.by_letters(F.col("track_id")), [F.col("track_id")], "place").withColumnRenamed("track_id", name)

    return catalog.zipped(placed(c, "contour_id"), placed(m, "meta_id")).select("place", "contour_id", "meta_id")


def u05_merged_paths(spark, d):
    """Distinct ragas of the vocabulary, then of tracks, then of listings, each where it comes first."""
    parts = [vocab(spark, d).select(F.col("raga_name").alias("raga"), F.col("raga_id").alias("place")), tracks(spark, d).select("raga", F.col("row_id").alias("place")), scraped(spark, d).select("raga", F.col("row_id").alias("place"))]
    return catalog.merged_paths(parts, "raga").select("raga", F.col("place.part").alias("part"), F.col("place.place").alias("place"))


def a24_epoch_means(spark, d):
    """Means of batches, weighted by their rows; a batch is a line item, its epoch the line's number."""
    b = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("epoch"), F.col("l_discount").alias("loss"), F.col("l_quantity").cast("long").alias("n"), F.floor(F.col("l_quantity") / 2).alias("correct"))
    return evaluate.epochs(b).select("epoch", F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"))


def a15_weighted_loss(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_discount").alias("loss"), F.col("l_quantity").cast("long").alias("n"))
    return evaluate.weighted_loss(t).select(F.round("loss", 6).alias("loss"), "n")


def w16_stop_epoch(spark, d):
    """Where training would stop, were the months' mean order prices its losses."""
    m = table(spark, d, "orders").groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("epoch")).agg(F.round(F.avg("o_totalprice"), 4).alias("loss"))
    return evaluate.stop_epoch(m)


def f20_true_beats(spark, d):
    """Annotated beats of a cycle, else from tempo and the seconds between samas."""
    x = table(spark, d, "lineitem")
    told = tala.true_beats(F.nullif(F.col("l_linenumber") - 1, F.lit(0)).cast("string"), F.col("l_quantity").cast("string"), (F.col("l_tax") * 100).cast("string"))
    return x.select("l_orderkey", "l_linenumber", told.alias("beats"))


def f18_now(spark, d):
    """Whether the time of the query is in the form asked for, for each table's count."""
    form = text.utc_now().rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}\+00:00$")
    return a20_counts(spark, d).select("name", form.alias("fine"))


QUERIES = {k: f for k, f in dict(globals()).items() if callable(f) and getattr(f, "__module__", "") == __name__ and k[0] in "asjkuwmfl" and k[1:2] not in ("_",) and any(c.isdigit() for c in k[:4])}

#: Letters of full width and spaces other than the ordinary one, with what compatibility decomposition makes of them.
_WIDE = "".join(map(chr, range(0xFF10, 0xFF5F))) + "\u00a0\u2007\u202f\u3000"
_PLAIN = "".join(map(chr, range(0x30, 0x7F))) + "    "
_LATEST = "QUALIFY row_number() OVER (PARTITION BY {0} ORDER BY {1}) = 1"
_FORMS = ", ".join(f"'{x}'" for x in text.FORMS)
_REAL = f"""(trim(title) <> '' AND NOT regexp_matches(title, '[0-9]{{1,2}}:[0-9]{{2}}') AND length(low) >= 3 AND low NOT IN ({_FORMS}))"""
_LOW = "(SELECT *, trim(regexp_replace(regexp_replace(lower(trim(title)), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS low FROM scraped_compositions WHERE title IS NOT NULL)"
_FOLD = "regexp_replace(lower(strip_accents({0})), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_INDEX = f"""(SELECT key, raga_name AS canonical FROM (SELECT raga_id, raga_name, p, {_FOLD.format('x')} AS key FROM (
  SELECT raga_id, raga_name, 0 AS p, raga_name AS x FROM raga_vocab UNION ALL SELECT raga_id, raga_name, 1, unnest(string_split(raga_name, '/')) FROM raga_vocab)) WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY p, raga_id) = 1)"""
_PROMPT = """'Composition: ' || composition_name || chr(10) || 'Composer: ' || composer || chr(10) || 'Raga: ' || raga || chr(10) || 'Tala: ' || tala || chr(10) || 'Language: ' || language || chr(10) || chr(10) || 'Lyrics:' || chr(10) || 'Pallavi:' || chr(10) || pallavi
  || CASE WHEN anupallavi <> '' THEN chr(10) || chr(10) || 'Anupallavi:' || chr(10) || anupallavi ELSE '' END
  || coalesce(list_reduce(list_transform(from_json(charanam, '["VARCHAR"]'), lambda v, i: chr(10) || chr(10) || 'Charanam ' || i || ':' || chr(10) || v), lambda a, b: a || b, ''), '') || chr(10) || chr(10) || 'Explain the meaning of these lyrics in English.'"""
_TOLD = "(SELECT raga AS label, raga_canonical AS prediction FROM scraped_compositions WHERE raga IN (SELECT raga_name FROM raga_vocab))"
_TALA14 = """w AS (SELECT row_id, composer, regexp_replace(lower(trim(tala)), '\\s+', ' ', 'g') AS label FROM compositions WHERE composer <> '' AND tala <> ''),
  c AS (SELECT composer, label, count(*) AS n FROM w GROUP BY composer, label QUALIFY row_number() OVER (PARTITION BY composer ORDER BY count(*) DESC, label) = 1), j AS (SELECT row_id, w.label, c.label AS prediction FROM w JOIN c USING (composer))"""
_SPELLINGS = ", ".join(f"('{x}', '{name}')" for name, spellings in text.TALAS.items() for x in spellings)
_INSTRUMENTS = ", ".join(f"'{x}'" for x in text.INSTRUMENTS)
SQL = {
    "sp08_listing_lines": f"""SELECT row_id, trim(p[1], ' .–—-') AS title, trim(p[2], ' .–—-') AS raga FROM (SELECT row_id, line, regexp_split_to_array(trim(line, ' '), '\\s+[–—-]\\s+') AS p FROM (SELECT row_id, concat_ws(' - ', title, raga) AS line FROM scraped_compositions))
      WHERE len(p) >= 2 AND NOT starts_with(lower(trim(line, ' ')), 'with') AND trim(p[1], ' .–—-') <> '' AND trim(p[2], ' .–—-') <> '' AND length(trim(p[1], ' .–—-')) <= 60 AND length(trim(p[2], ' .–—-')) <= 40 AND lower(trim(p[2], ' .–—-')) NOT IN ({_INSTRUMENTS})""",
    "f15_display": """SELECT row_id, array_to_string(list_transform(string_split(lower(replace(x, '-', ' ')), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name
      FROM (SELECT row_id, list_filter(string_split(regexp_extract(source_url, '^[a-z]+://[^/]+([^?#]*)', 1), '/'), lambda p: p <> '')[2] AS x FROM scraped_compositions)""",
    "f22_percent": "SELECT raga, format('{:,.1f}%', round_even(n / 7.0::DOUBLE, 1)) AS shown, lpad((n // 60)::VARCHAR, greatest(2, 2), '0') || ':' || lpad((n % 60)::VARCHAR, 2, '0') AS clock FROM (SELECT raga, count(*) AS n FROM tracks_meta GROUP BY raga)",
    "sp14_projection": "SELECT track_id, title, tonic, raga FROM tracks_meta",
    "j05_zipped": "SELECT place, contour_id, meta_id FROM (SELECT row_number() OVER (ORDER BY track_id) AS place, track_id AS contour_id FROM composition_catalog_contours) JOIN (SELECT row_number() OVER (ORDER BY track_id) AS place, track_id AS meta_id FROM (SELECT DISTINCT track_id FROM composition_catalog_meta WHERE track_id IS NOT NULL)) USING (place)",
    "u05_merged_paths": "SELECT raga, part::INT AS part, place::BIGINT AS place FROM (SELECT raga_name AS raga, 0 AS part, raga_id AS place FROM raga_vocab UNION ALL SELECT raga, 1, row_id FROM tracks_meta UNION ALL SELECT raga, 2, row_id FROM scraped_compositions) WHERE raga IS NOT NULL QUALIFY row_number() OVER (PARTITION BY raga ORDER BY part, place) = 1",
    "a24_epoch_means": "SELECT l_linenumber AS epoch, round(sum(l_discount * floor(l_quantity)) / sum(floor(l_quantity)), 6) AS loss, round(sum(floor(l_quantity / 2)) / sum(floor(l_quantity)), 6) AS accuracy FROM lineitem GROUP BY l_linenumber",
    "a15_weighted_loss": "SELECT round(sum(l_discount * floor(l_quantity)) / sum(floor(l_quantity)), 6) AS loss, sum(floor(l_quantity))::BIGINT AS n FROM lineitem",
    "w16_stop_epoch": """WITH m AS (SELECT (year(o_orderdate) * 12 + month(o_orderdate))::INT AS epoch, round(avg(o_totalprice), 4) AS loss FROM orders GROUP BY 1),
      b AS (SELECT *, coalesce(loss < min(loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM m), s AS (SELECT *, max(CASE WHEN better THEN epoch END) OVER (ORDER BY epoch) AS best FROM b),
      e AS (SELECT coalesce(min(CASE WHEN epoch - best >= 8 THEN epoch END), max(epoch)) AS last FROM s) SELECT s.best AS best_epoch, m.loss AS best_loss, s.epoch AS last_epoch FROM s JOIN e ON s.epoch = e.last JOIN m ON m.epoch = s.best""",
    "f20_true_beats": "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 1 THEN (l_linenumber - 1)::INT WHEN l_quantity > 0 AND l_tax > 0 THEN round_even(l_quantity * (l_tax * 100) / 60.0::DOUBLE, 0)::INT END AS beats FROM lineitem",
    "f18_now": "SELECT name, true AS fine FROM (VALUES ('tracks_meta'), ('compositions'), ('lyrics_catalog'), ('scraped_compositions')) t(name)",
    "s04_tracks": "SELECT track_id, key, title, tonic, raga FROM tracks_meta",
    "s07_usable_tracks": "SELECT row_id, track_id, title, round(tonic, 6) AS tonic FROM tracks_meta WHERE title <> '' AND tonic > 0 AND track_id IN (SELECT track_id FROM composition_catalog_contours WHERE contour IS NOT NULL)",
    "s08_bundle": "SELECT row_id, track_id, coalesce(nullif(title, ''), track_id) AS title, coalesce(raga, '') AS raga FROM tracks_meta WHERE tonic > 0 AND track_id IN (SELECT track_id FROM composition_catalog_contours)",
    "s09_track_index": "SELECT row_id, track_id, coalesce(title, track_id) AS title, coalesce(raga, '') AS raga FROM tracks_meta WHERE tonic IS NOT NULL AND track_id IN (SELECT track_id FROM composition_catalog_contours)",
    "s07_skipped": "SELECT count(*) AS total, count(*) FILTER (title <> '' AND tonic > 0 AND contour IS NOT NULL) AS usable, count(*) - count(*) FILTER (title <> '' AND tonic > 0 AND contour IS NOT NULL) AS skipped FROM tracks_meta LEFT JOIN composition_catalog_contours USING (track_id)",
    "f16_joined": "SELECT row_id, regexp_replace(source_url, '[^/]*$', '') || 'c12.shtml' AS url FROM scraped_compositions",
    "s12_training_scan": "SELECT row_id, raga, round(coalesce(nullif(tonic, 0), 220), 6) AS tonic FROM tracks_meta WHERE raga <> ''",
    "s23_vocabulary": "SELECT name, (row_number() OVER (ORDER BY name))::INT AS rank FROM (SELECT DISTINCT raga_name AS name FROM raga_vocab WHERE raga_name IN (SELECT raga FROM tracks_meta WHERE raga <> ''))",
    "s25_seeds": f"SELECT row_id, title, raga FROM scraped_compositions WHERE trim(title) <> '' AND title NOT IN (SELECT title FROM lyrics_catalog WHERE title IS NOT NULL) {_LATEST.format('title', 'row_id')}",
    "sp06_by_raga": "SELECT row_id, raga FROM tracks_meta WHERE lower(trim(raga, ' ')) IN (SELECT lower(trim(raga_name, ' ')) FROM raga_vocab)",
    "sp07_real_titles": f"SELECT row_id FROM {_LOW} WHERE {_REAL}",
    "sp09_artist_pages": "SELECT row_id FROM scraped_compositions WHERE regexp_matches(source_url, '^https?://[^/]*concerts[^/]*/+artist/+[^/?#]+/*$')",
    "sp10_song_links": "SELECT row_id, regexp_matches(source_url, 'c[0-9]+\\.shtml') OR contains(source_url, '/lyrics/') AS song FROM scraped_compositions",
    "sp12_uncertain": "SELECT artist, round(top, 6) AS top, top < 0.3 AS uncertain, CASE WHEN top < 0.5 THEN 'low' ELSE 'fine' END AS label FROM (SELECT artist, max(n)::DOUBLE / sum(n) AS top FROM (SELECT artist, raga_canonical, count(*) AS n FROM scraped_compositions WHERE raga_canonical <> '' GROUP BY ALL) GROUP BY artist)",
    "sp16_first_of_list": "SELECT row_id, coalesce(v[1], '') AS first, len(v)::INT AS n FROM (SELECT row_id, from_json(charanam, '[\"VARCHAR\"]') AS v FROM compositions)",
    "sp17_clean_batch": f"SELECT row_id, title FROM scraped_compositions WHERE trim(title) <> '' {_LATEST.format('title', 'row_id')}",
    "sp20_labels": "SELECT row_id, CASE WHEN count(*) OVER (PARTITION BY title) > 1 THEN title || ' (' || track_id || ')' ELSE title END AS label FROM tracks_meta WHERE title IS NOT NULL",
    "j04_lookup": f"SELECT m.row_id, m.track_id, t.title, t.raga FROM composition_catalog_meta m LEFT JOIN (SELECT track_id, title, raga FROM tracks_meta {_LATEST.format('track_id', 'row_id DESC')}) t USING (track_id)",
    "j06_aliases": "SELECT row_id, raga, raga_id FROM scraped_compositions LEFT JOIN raga_vocab ON raga_name = trim(raga, ' ')",
    "f10_fold_index": f"SELECT key, canonical FROM {_INDEX}",
    "j07_resolved": f"""SELECT raw, CASE WHEN h.key IS NULL THEN x.canonical END AS canonical, (CASE WHEN h.key IS NOT NULL THEN 1 WHEN x.key IS NOT NULL THEN 2 ELSE 0 END)::INT AS tier
      FROM (SELECT raga AS raw, {_FOLD.format('raga')} AS k FROM scraped_compositions WHERE raga IS NOT NULL GROUP BY raga) LEFT JOIN (VALUES ('unknown'), ('encore'), ('tuning'), ('missing')) h(key) ON h.key = k LEFT JOIN {_INDEX} x ON x.key = k""",
    "j09_lyrics_of_match": """WITH w AS (SELECT DISTINCT composition_name AS wanted FROM compositions WHERE composition_name <> ''), n AS (SELECT DISTINCT title FROM lyrics_catalog WHERE title IS NOT NULL)
      SELECT wanted, coalesce(e.title, (SELECT min(n.title) FROM n WHERE translate(n.title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%' || translate(wanted, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '%')) AS title FROM w LEFT JOIN n e ON e.title = wanted""",
    "j11_meanings": f"""WITH w AS (SELECT * FROM compositions {_LATEST.format('composition_id', 'row_id DESC')}), l AS (SELECT title, meaning_en FROM lyrics_catalog WHERE title IS NOT NULL {_LATEST.format('title', 'row_id DESC')})
      SELECT composition_id, coalesce(nullif(meaning_en, ''), 'Composition: ' || composition_name) AS meaning, CASE WHEN nullif(meaning_en, '') IS NULL THEN 'provider' ELSE 'stored' END AS generated_by FROM w LEFT JOIN l ON title = composition_name""",
    "j12_rendered_twice": "SELECT row_id, title FROM tracks_meta WHERE title IN (SELECT title FROM tracks_meta WHERE title <> '' GROUP BY title HAVING count(DISTINCT track_id) >= 2)",
    "j13_missing": "SELECT DISTINCT title FROM scraped_compositions WHERE title <> '' AND title NOT IN (SELECT title FROM lyrics_catalog WHERE title IS NOT NULL)",
    "j14_tala_truth": f"WITH {_TALA14} SELECT * FROM j",
    "a16_accuracy": f"WITH {_TALA14} SELECT count(*) AS n, count(CASE WHEN label = prediction THEN 1 END) AS correct, round(avg(CASE WHEN label = prediction THEN 1 ELSE 0 END), 6) AS accuracy FROM j",
    "j15_rendition_pairs": f"""WITH o AS (SELECT title, track_id, row_id FROM tracks_meta WHERE title <> '' {_LATEST.format('track_id', 'row_id')})
      SELECT title, reference_id, track_id AS query_id FROM (SELECT title, track_id, row_number() OVER w AS r, first_value(track_id) OVER w AS reference_id FROM o WINDOW w AS (PARTITION BY title ORDER BY row_id)) WHERE r > 1""",
    "a07_title_counts": "SELECT title, count(*) AS n FROM scraped_compositions GROUP BY title",
    "k06_real_titles": f"SELECT title, count(*) AS n FROM {_LOW} WHERE {_REAL} GROUP BY title ORDER BY n DESC, title LIMIT 30",
    "k08_report": "SELECT raga, count(*) AS n FROM tracks_meta WHERE raga <> '' GROUP BY raga ORDER BY n DESC, raga LIMIT 20",
    "a09_repeated": "SELECT count(*) AS titles, coalesce(sum(n), 0)::BIGINT AS tracks FROM (SELECT count(*) AS n FROM tracks_meta WHERE title <> '' GROUP BY title HAVING count(*) >= 2)",
    "a14_confusion": f"SELECT label, prediction, count(*) AS n FROM {_TOLD} GROUP BY ALL",
    "a15_by_class": f"SELECT label, count(*) AS n, round(coalesce(avg(CASE WHEN prediction IS NULL THEN NULL WHEN label = prediction THEN 1.0 ELSE 0 END), 0), 6) AS accuracy FROM {_TOLD} GROUP BY label",
    "a18_best": f"SELECT label, n FROM (SELECT label, count(*) AS n FROM {_TOLD} WHERE prediction IS NOT NULL GROUP BY label) ORDER BY n DESC, label DESC LIMIT 1",
    "a19_mapped": "SELECT count(DISTINCT raga) AS spellings, count(raga_canonical) AS mapped, count(*) AS n, round(count(raga_canonical) / count(*)::DOUBLE, 6) AS part FROM scraped_compositions WHERE trim(raga) <> ''",
    "a20_counts": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("tracks_meta", "compositions", "lyrics_catalog", "scraped_compositions")),
    "k04_ordered": "SELECT row_id, composer, (row_number() OVER (PARTITION BY composer ORDER BY composition_name, row_id))::INT AS place FROM compositions",
    "u01_union": "SELECT title, 'tracks' AS origin FROM tracks_meta UNION ALL SELECT title, 'scrape' FROM scraped_compositions",
    "u02_priority_union": "SELECT raga_name AS name, 0 AS priority FROM raga_vocab UNION ALL SELECT raga, 1 FROM (SELECT DISTINCT raga FROM tracks_meta WHERE raga <> '' AND raga NOT IN (SELECT raga_name FROM raga_vocab))",
    "u03_distinct": "SELECT DISTINCT tala FROM compositions",
    "u04_merged": f"SELECT raga, composer FROM (SELECT raga, composer, row_id, 0 AS later FROM compositions UNION ALL SELECT raga, composer, row_id, 1 FROM lyrics_catalog) WHERE raga <> '' AND composer <> '' {_LATEST.format('raga', 'later DESC, row_id DESC')}",
    "w08_first_and_rest": "SELECT row_id, row_number() OVER (PARTITION BY title ORDER BY row_id) = 1 AS first FROM scraped_compositions WHERE title IS NOT NULL",
    "w09_keys": "SELECT row_id, 't' || (row_number() OVER (ORDER BY row_id) - 1) AS key FROM tracks_meta",
    "w13_sections": """SELECT row_id AS page_id, trim(pallavi, ' ') AS pallavi, trim(anupallavi, ' ') AS anupallavi, coalesce(array_to_string(list_filter(list_transform(from_json(charanam, '["VARCHAR"]'), lambda v: trim(v, ' ')), lambda v: v <> ''), '|'), '') AS charanam
      FROM compositions WHERE trim(pallavi, ' ') <> '' OR trim(anupallavi, ' ') <> '' OR charanam <> '[]'""",
    "w14_failure_runs": """WITH x AS (SELECT language, meaning_en IS NULL AS fail, row_number() OVER (PARTITION BY language ORDER BY added_at, row_id) - row_number() OVER (PARTITION BY language, meaning_en IS NULL ORDER BY added_at, row_id) AS island FROM lyrics_catalog)
      SELECT language, max(n) AS longest, count(CASE WHEN n >= 5 THEN 1 END) AS stops FROM (SELECT language, island, count(*) AS n FROM x WHERE fail GROUP BY ALL) GROUP BY language""",
    "m01_upserted": """WITH w AS (SELECT *, row_id % 2 AS odd FROM compositions QUALIFY row_number() OVER (PARTITION BY composition_id, row_id % 2 ORDER BY updated_at DESC, row_id DESC) = 1)
      SELECT composition_id, composer, raga, row_id FROM w QUALIFY row_number() OVER (PARTITION BY composition_id ORDER BY odd) = 1""",
    "m02_inserted": "SELECT count(DISTINCT title) AS n_added FROM scraped_compositions WHERE trim(title) <> '' AND title NOT IN (SELECT title FROM lyrics_catalog WHERE title IS NOT NULL)",
    "m03_updated": f"""SELECT l.row_id, l.title, CASE WHEN c.title IS NOT NULL THEN c.m ELSE l.meaning_en END AS meaning_en FROM lyrics_catalog l
      LEFT JOIN (SELECT title, 'set in ' || coalesce(raga_canonical, '?') AS m FROM scraped_compositions WHERE title IS NOT NULL {_LATEST.format('title', 'row_id')}) c ON c.title = l.title""",
    "m04_point": "SELECT row_id, composition_id FROM compositions WHERE composition_id = (SELECT min(composition_id) FROM compositions)",
    "m05_search": " UNION ALL ".join(f"SELECT '{c}' AS field, row_id FROM compositions WHERE translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%{p}%'" for c, p in (("composition_name", "maruva"), ("raga", "ji%ri"), ("composer", "n. "))),
    "m06_listed": f"SELECT composition_id, composer, composition_name FROM compositions {_LATEST.format('composition_id', 'row_id DESC')}",
    "f07_tala": f"SELECT row_id, coalesce(canonical, k) AS tala FROM (SELECT row_id, coalesce(regexp_replace(lower(trim(tala, ' ')), '\\s+', ' ', 'g'), '') AS k FROM compositions) LEFT JOIN (VALUES {_SPELLINGS}) t(spelling, canonical) ON spelling = k",
    "f08_slug": f"SELECT row_id, trim(regexp_replace(regexp_replace(lower(strip_accents(translate(composition_name, '{_WIDE}', '{_PLAIN}') || '-' || composer)), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM compositions",
    "f09_fold": f"SELECT row_id, {_FOLD.format('composer')} AS folded FROM compositions",
    "f11_fields": "SELECT row_id, trim(raga, ' ') AS raga, trim(tala, ' ') AS tala, '' AS language FROM compositions",
    "f12_language": "SELECT row_id, CASE WHEN contains(l, 'telugu') THEN 'Telugu' WHEN contains(l, 'sanskrit') THEN 'Sanskrit' WHEN contains(l, 'tamil') THEN 'Tamil' WHEN contains(l, 'kannada') THEN 'Kannada' WHEN contains(l, 'malayalam') THEN 'Malayalam' ELSE 'Unknown' END AS language FROM (SELECT row_id, lower(language) AS l FROM compositions)",
    "f16_address": "SELECT row_id, regexp_extract(source_url, '^[a-z]+://([^/]+)', 1) AS host, 'https://one.example' || regexp_extract(source_url, '^[a-z]+://[^/]+([^?#]*)', 1) AS url FROM scraped_compositions",
    "f17_json": "SELECT row_id, len(from_json(charanam, '[\"VARCHAR\"]'))::INT AS n, to_json(from_json(charanam, '[\"VARCHAR\"]'))::VARCHAR AS encoded FROM compositions",
    "f19_prompt": f"SELECT row_id, {_PROMPT} AS prompt FROM compositions",
    "l01_labels": "SELECT raga, (row_number() OVER (ORDER BY raga) - 1)::INT AS code FROM (SELECT DISTINCT raga FROM tracks_meta WHERE raga <> '')",
    "l05_folds": "SELECT vec_id, ((row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || '-42'), vec_id) - 1) % 5)::INT AS fold FROM embeddings",
}
