"""SpotSigs fingerprints: chains of content words that follow common words.

Every common word (and the start of the text) is an anchor; its signature is the anchor
with the next two words that are not common. A word that no anchor's chain holds, because
neither it nor the word before follows a common word, has a signature with the word after
it and no anchor, so every word of a text that is not common is in a signature. A
fingerprint is the set of signatures.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumberline.functions.binding import let
from lumberline.llm.store import stored

# Common words of English, German, French and Spanish.
ANCHORS = tuple(dict.fromkeys("""
the a an and or but if then than that this these those there here is am are was were be been being do does did done doing
have has had having will would shall should can could may might must i you he she it we they me him her us them my your his
its our their mine yours hers ours theirs who whom whose which what when where why how not no nor so too very just only own
same such some any each every all both few more most other another of at by for with about against between into through during
before after above below to from up down in out on off over under again further once as until while because also now ever never
der die das den dem des ein eine einen einem einer eines und oder aber wenn dann als dass daß ob weil ist bin bist sind seid war
waren warst wird werden wurde wurden habe hat haben hatte hatten kann können konnte muss müssen soll sollen will wollen ich du er
sie es wir ihr mich dich ihn uns euch mir dir ihm ihnen mein meine dein deine sein seine ihre unser unsere euer dieser diese dieses
diesen diesem jener jene jedes jeder jede alle nicht kein keine keinen nur noch schon auch sehr so wie was wer wo warum hier da dort
in im an am auf aus bei mit nach von vom vor zu zum zur für gegen ohne um durch über unter zwischen bis seit während doch nun man
le la les un une des du de au aux et ou mais si donc car ni que qui quoi dont où quand comment pourquoi est suis es sommes êtes sont
était étaient été être sera ai as a avons avez ont avait avaient avoir je tu il elle on nous vous ils elles me te se lui leur leurs
mon ma mes ton ta tes son sa ses notre nos votre vos ce cet cette ces ne pas plus moins très aussi même tout tous toute toutes
dans en sur sous avec sans pour par chez vers entre avant après depuis pendant comme y
el los las una unos unas del al y e o u pero sino porque como cuando donde quien cual cuyo qué cómo cuándo dónde quién soy eres
somos son era eran fue fueron ser sido está están estoy estaba estar he has ha hemos han había haber yo tú él ella nosotros ellos
ellas usted ustedes lo les se mi mis tu tus su sus nuestro nuestra este esta estos estas ese esa esos esas aquel aquella no sí ni
muy más menos también ya todo toda todos todas otro otra con sin por para sobre entre hasta desde hacia durante ante bajo según
""".split()))


def _trie(words: tuple[str, ...]) -> str:
    """A pattern for any of the words, in which words share their beginnings; the longest first."""
    if words == ("",):
        return ""
    heads = sorted({w[0] for w in words if w})
    ways = [h + _trie(tuple(sorted({w[1:] for w in words if w.startswith(h)}))) for h in heads]
    return f"(?:{'|'.join(ways)})" + ("?" if "" in words else "")


# An anchor between spaces is tied to the word behind it: chains then are found by position.
_TIE = "\x1f"
_ANCHOR = f"(?<= )({_trie(ANCHORS)}) "
_LOWEST = -(1 << 63)


def signature_set(text: Column) -> Column:
    """The sorted distinct 64-bit signatures of a text; none for a text without letters or digits."""
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    tied = F.trim(F.regexp_replace(F.concat(F.lit(" "), words, F.lit(" ")), _ANCHOR, f"$1{_TIE}"))
    # Of each word that is not common: the anchors before it, and itself.
    runs = F.transform(F.split(F.concat(F.lit(f"^{_TIE}"), tied), " "), lambda w: F.split(w, _TIE))

    def chains(runs: Column) -> Column:
        def of(run: Column, i: Column) -> Column:
            following = F.coalesce(F.element_at(F.get(runs, i + 1), -1), F.lit(""))
            sign = lambda anchor: F.xxhash64(F.concat_ws(" ", anchor, F.element_at(run, -1), following))
            held = (F.size(run) > 1) | (F.size(F.get(runs, i - 1)) > 1)
            # The anchors are all but the last; a word that no chain holds has an empty one.
            return F.transform(F.when(held, F.slice(run, 1, F.size(run) - 1)).otherwise(F.array(F.lit(""))), sign)

        return F.flatten(F.transform(runs, of))

    spots = let(runs, chains)
    return F.when(words == "", F.expr("cast(array() as array<bigint>)")).otherwise(F.array_sort(F.array_distinct(spots)))


def fingerprint(signatures: Column) -> Column:
    """The set as text: 16 hexadecimal digits for each signature, in order."""
    return F.array_join(F.transform(signatures, lambda s: F.lpad(F.hex(s), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; two empty sets are alike."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def followed(docs: DataFrame) -> DataFrame:
    """``d, h, pd, ph, need``: each text's key, the key of the one before, and a quarter of that one's length.

    Texts are ordered by (d, h); the first one follows the last. Only keys and lengths
    move here: they are dealt out by ranges, and the few ranges are put in order.
    """
    keys = docs.select("d", "h", F.length("text").cast("bigint").alias("n")).distinct()
    ranged = stored(keys.repartitionByRange("d", "h").withColumn("part", F.spark_partition_id()), "ranges")
    row = F.struct("d", "h", "n")
    ends = ranged.groupBy("part").agg(F.max(row).alias("end"))  # one row a range
    in_order = Window.orderBy("part")
    every = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("end").over(in_order), F.last("end").over(every)).alias("end"))
    before = F.lag(row).over(Window.partitionBy("part").orderBy("d", "h"))
    linked = ranged.withColumn("before", before).join(ends, "part").withColumn("before", F.coalesce("before", "end"))
    return linked.select("d", "h", F.col("before.d").alias("pd"), F.col("before.h").alias("ph"), F.floor(F.col("before.n") / 4).cast("int").alias("need"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and how alike they and the next text's are.

    The edited text has its last quarter replaced by as many first characters of the next
    text. NULL texts are empty and NULL ids come first. Rows that repeat id and text share
    their neighbours; rows that share an id only follow each other by a hash of the text.
    Other columns are not carried.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LOWEST)).alias("d"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    links = followed(own)
    # Texts move, not signatures: those are more bytes than the words they are made of.
    linked = own.join(links, ["d", "h"])
    following = linked.select(F.col("pd").alias("d"), F.col("ph").alias("h"), F.col("text").alias("next"), "need")
    following = following.groupBy("d", "h").agg(F.first("next").alias("next"), F.first("need").alias("need"))
    n = F.length("text")
    kept = F.substring("text", F.lit(1), (n - F.floor(n / 4)).cast("int"))
    patch = F.substring("next", F.lit(1), F.col("need"))
    both = linked.select("d", "h", "text").join(following, ["d", "h"]).withColumn("edited", F.concat(kept, patch))
    both = both.withColumns({"sigs": signature_set(F.col("text")), "edited_sigs": signature_set(F.col("edited")), "next_sigs": signature_set(F.col("next"))})
    return both.select(
        F.when(F.col("d") != _LOWEST, F.col("d")).alias("doc_id"),
        n.cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def signature_classes(docs: DataFrame) -> DataFrame:
    """``rep, sigs, members``: one row for each distinct set that is not empty; rep is its least doc_id."""
    signed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), signature_set(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("sigs"))
    return signed.filter(F.size("sigs") > 0).groupBy("sigs").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"))


def similar_classes(classes: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``a, b, similarity`` of all pairs of distinct sets with at least ``threshold``, a < b.

    Sets are partitioned by length, each partition reaching from a length to that length
    over the threshold, so a set meets its own partition and the next. Within them, sets
    that are similar enough share one of their rarest signatures (as many as a set may
    lack, and one), and lengths must allow the threshold.
    """
    step = math.log(1 / threshold)
    lengths = classes.select("rep", "sigs", F.size("sigs").alias("n")).withColumn("band", F.floor(F.log("n") / step + 1e-9).cast("int"))
    spots = lengths.select("rep", "n", "band", F.explode("sigs").alias("s"))
    rarity = spots.groupBy("s").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("df", "s"))
    prefix = spots.join(rarity, "s").withColumn("i", rank).filter(F.col("i") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1)
    left = prefix.select("s", F.col("rep").alias("x"), F.col("n").alias("nx"), F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    right = prefix.select("s", "band", F.col("rep").alias("y"), F.col("n").alias("ny"))
    fits = (F.col("nx") <= F.col("ny")) & (F.col("nx") >= threshold * F.col("ny") - 1e-9) & (F.col("x") != F.col("y"))
    pairs = left.join(right, ["s", "band"]).filter(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    sets = lengths.select("rep", "sigs")
    full = pairs.join(sets.withColumnsRenamed({"rep": "a", "sigs": "sa"}), "a").join(sets.withColumnsRenamed({"rep": "b", "sigs": "sb"}), "b")
    return full.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("similarity")).filter(F.col("similarity") >= threshold - 1e-12)
