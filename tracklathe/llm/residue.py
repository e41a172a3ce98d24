"""Template residue, filler, error pages and script notices in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklathe.session import cut, settle

# Forms of an unfilled placeholder around a name, in prose outside code and quotations.
_NAME = r"[A-Za-zÀ-ɏ][A-Za-zÀ-ɏ_.]*(?: [A-Za-zÀ-ɏ_.]+){0,3}"
PLACEHOLDERS = [
    rf"\{{\{{\{{? ?{_NAME} ?\}}?\}}\}}",
    rf"\{{% ?{_NAME} ?%\}}",
    rf"<%=? ?{_NAME} ?%>",
    rf"[$#]\{{ ?{_NAME} ?\}}",
    rf"(?<![\w$#{{\"'/])\{{(?:{_NAME}|\d{{1,2}})\}}(?![\w}}\"'/])",
    rf"%\({_NAME}\)[sd]",
    r"(?<![\w%])%[A-Za-z][A-Za-z_.]*(?: [A-Za-z_.]+)?%(?!\w)",
    r"(?<![\w%.,])%s(?!\w)",
    rf"@@{_NAME}@@",
    r"(?<![\w$])\$[A-Za-z][A-Za-z_.]*(?: [A-Za-z_.]+)?\$(?![\w$])",
    rf"«{_NAME}»",
    r"(?<!\w)__[A-Za-z][A-Za-z_. ]*?__(?!\w)",
    r"(?<![\w_])_{3,8}(?![\w_])",
    r"(?<!\w)XX\.X(?!\w)",
    rf"\[\[{_NAME}\]\]",
    r"(?i)\[(?:insert|your|tbd:?|todo:?|enter|add|pon aquí|à compléter ?:?) [^\]\n]++\]",
    r"(?i)\[[^\]\n]+ (?:einsetzen|eintragen|here|goes here)\]",
    r"(?<![\w\]])\[[A-Za-z_.]{3,}(?: [A-Za-z_.]+)?\](?![\w(\[])",
    r"(?i)\((?:fill in|insert|your) [A-Za-z_. ]++\)",
    r"(?i)<(?:insert |your )?[a-z_. ]{2,}? (?:goes )?here>",
    r"<(?!/|(?:b|i|u|s|p|a|br|hr|h[1-6]|em|li|ol|ul|td|th|tr|dl|dt|dd|kbd|pre|sub|sup|div|var|code|span|html|head|body|link|meta|table|title|script|strong|noscript|img|input|form|label|button)\b)[A-Za-z][A-Za-z_.]*(?: [A-Za-z_.]+)?>",
]
# Stems by which a message of a site speaks, in the corpus' six languages; words and word parts, no sentences.
STEMS = {
    "script": r"(?<!\p{L})(?:java ?script|scripts?\b|scripting|client-side scripting|js\b|cookies\b|your browser)|ジャバスクリプト|javascript|जावास्क्रिप्ट",
    "filler": r"(?<!\p{L})(?:placeholder|blah\b|sample text|blindtext|platzhalter|(?:text|title|description|content) (?:goes )?here\b|coming soon|relleno\b|texte d'exemple|lorem,? ipsum)|नमूना|サンプル|⁂",
    "error": (
        r"(?<!\p{L})(?:error\b|fehler\b|erreur\b|http\b|not found|(?:not|cannot|can't) (?:be )?(?:found|load|open|display)|could not|no se encontró|introuvable|nicht gefunden|denied|denegado|refusé|verweigert|forbidden|"
        r"unauthori[sz]ed|expired|sign in|log ?in again|unavailable|(?:internal |upstream |the )?server\b|gateway|too many requests|try again|no route matches|(?:removed|moved) or|is private|went wrong|something broke|oops\b|traceback|permission|"
        r"time-?d? ?out|took too long|connection|administrator|maintenance)|त्रुटि|エラー|見つかりません"
    ),
}
KINDS = list(STEMS)
# The syllables of the well-known mock Latin passage.
SYLLABLES = "ad ali am aut bo cin ci com con co dol do ea eius eli er es ex iam in lam la lit lo mag mi mo na nis nos pis por qua quis rem re sec sed se sit sum ip ta tem te tru tur ul ut ven ve"
SPACE = r"\s\u0085\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
#: What stands around a sentence without being of it.
TRIM = " .,:;!?…。।#*>-–—_|/\\\"'`“”„«»()[]{}=+~•·\t"
#: Words by which a sentence speaks about placeholders or code.
TALK = r"formatter|parser|help text|argument name|exporter|report generator|copy the line"
#: What a sentence that quotes or reports has and a site's message has not; it only matters for sentences that don't recur.
REPORT = r"[\"“”„«»`;]|\b(?:was|were|had|said|used|cost|kept|this week|i|our (?!side)|lab|war|haben|était|venait|venía|fue)\b|था|थी|でした"
#: A token said over and over, as in keyboard filler, a repeat perhaps with one more letter; every repeat ends at a word's end.
STUTTER = r"(?<![\p{L}\p{N}])(?:(\p{L}++)(?: \1\p{L}?(?![\p{L}\p{N}])){2,}+|(\p{L}++) \2(?= (\p{L}++|0) \3(?![\p{L}\p{N}])))(?: (\p{L}++|0)(?: \4\p{L}?(?![\p{L}\p{N}]))++)*+(?![\p{L}\p{N}])"


def masked(text: Column) -> Column:
    """Lower case, tags as line ends, addresses, dates and words with a digit as 0, single blanks; lines stay."""
    t = F.regexp_replace(text, r"<[^<>\n]++>", "\n")
    t = F.lower(F.regexp_replace(t, r"[\u0085\u2028\u2029\x0b\x0c]|\r\n?", "\n"))
    t = F.regexp_replace(t, r"[ \t\u00a0\u1680\u2000-\u200b\u202f\u205f\u3000\ufeff]++", " ")
    t = F.regexp_replace(t, r"https?://\S++|(?<![\w.+-])[\w.+-]++@[\w-]++\.[\w.]++", "0")
    return F.regexp_replace(t, r"(?<![\p{L}\p{N}])(?:unit-)?\p{L}*+\p{Nd}[\p{L}\p{N}]*+(?:[-.,:]\p{L}*+\p{Nd}[\p{L}\p{N}]*+)*+", "0")


def sentences(mask: Column) -> Column:
    """The masked text's sentences and lines; stutters and mock Latin are sentences ``⁂`` of their own.

    A sentence is mock Latin if three words in five are made of nothing but that passage's syllables.
    """
    t = F.regexp_replace(mask, r"(?m)(^|[.!?:。।] ?)lorem,? ipsum[^\n]*+", "$1\n⁂\n")
    t = F.regexp_replace(t, STUTTER, "\n⁂\n")
    parts = F.split(F.regexp_replace(t, r"[.!?…] |[。।]", "$0\n"), "\n")
    parts = F.transform(parts, lambda p: F.btrim(p, F.lit(TRIM)))
    word = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(SYLLABLES.split())})+(?![\p{{L}}\p{{N}}])"
    mock = lambda p: (F.size(F.split(p, " ")) > 1) & (F.regexp_count(p, F.lit(word)) >= 0.6 * F.size(F.split(p, " ")))
    return F.array_distinct(F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.when(mock(p), "⁂").otherwise(p)))


def prose(text: Column) -> Column:
    """The text without code fences, inline code, quotations, and sentences that speak about placeholders."""
    t = F.regexp_replace(text, r"(?s)```.*?(?:```|$)", " ")
    t = F.regexp_replace(t, r"`[^`\n]*+`", " ")
    t = F.regexp_replace(t, r"[\u00a0\u2000-\u200b\u202f\u3000]", " ")
    t = F.regexp_replace(t, r" {2,}", " ")
    t = F.regexp_replace(t, r"\"[^\"\n]*+\"", " ")
    return F.regexp_replace(t, rf"(?i)(?<![^.!?\n])[^.!?\n]*?\b(?:{TALK})\b[^.!?\n]*+", " ")


def _any(patterns: list[str]) -> str:
    return "(?:" + "|".join(patterns) + ")"


def _words(sentence: Column) -> Column:
    """Words of a sentence; where blanks are rare, every eight letters count as one."""
    return F.greatest(F.size(F.split(sentence, " ")), (F.length(sentence) / 8).cast("int"))


def _kind_of(sentence: Column) -> Column:
    kind = F
    for i, k in enumerate(KINDS):
        kind = kind.when(sentence.rlike(STEMS[k]), F.lit(i + 1))
    return kind.otherwise(F.lit(0))


def _sentences(documents: DataFrame, id_col: str, text_col: str, source_col: str, company: int, drop: int) -> DataFrame:
    """One row a text: its id, whether it holds a placeholder, and its distinct masked sentences as numbers.

    A sentence has its hash, words, kind by its stems (0 none), ``near`` (whether the other sentences without a stem have at
    most ``company`` words) and ``terse`` (short and not reporting). ``tails`` are the hashes of what is left of a sentence with a
    stem when up to ``drop`` leading words are taken off, for messages that stand behind a title on its line. ``s`` is the
    sentence itself in texts that have a stem, else null.
    """
    rows = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.lower(F.trim(F.coalesce(F.col(source_col), F.lit("")))).alias("_source"))
    rows = rows.where(F.col("_id").isNotNull() & F.col("_text").isNotNull()).where(F.col("_text").rlike(f"[^{SPACE}]"))
    sign = r"[{<«@\[]|%[s(A-Za-z]|\$[A-Za-z]|__|XX\.X|(?i)\((?:fill|insert|your)"
    holder = F.when(F.col("_text").rlike(sign), prose(F.col("_text")).rlike(r"(?=[{<$#%@_X\[(«])" + _any(PLACEHOLDERS))).otherwise(False)
    rows = settle(rows.select("_id", "_source", holder.alias("_holder"), sentences(masked(F.col("_text"))).alias("_s")))
    each = F.transform("_s", lambda s: F.struct(F.xxhash64(s).alias("h"), _words(s).alias("w"), _kind_of(s).alias("k"), s.alias("s")))
    rows = settle(rows.select("_id", "_source", "_holder", F.xxhash64(F.array_join("_s", "\n")).alias("_doc"), each.alias("_s")))
    plain = F.aggregate("_s", F.lit(0), lambda n, x: n + F.when(x["k"] == 0, x["w"]).otherwise(0))

    def tails(x: Column) -> Column:
        words = F.split(x["s"], " ")
        return F.transform(F.sequence(F.lit(1), F.least(F.size(words) - 1, F.lit(drop))), lambda n: F.xxhash64(F.array_join(F.slice(words, n + 1, F.size(words)), " ")))

    def number(x: Column) -> Column:
        terse = (x["k"] > 0) & (x["w"] <= 14) & ((x["s"] == "⁂") | ~x["s"].rlike(REPORT))
        return F.struct(
            x["h"], x["w"], x["k"], (F.col("_plain") - F.when(x["k"] == 0, x["w"]).otherwise(0) <= company).alias("near"), terse.alias("terse"),
            F.when((x["k"] > 0) & (x["w"] > 1), tails(x)).otherwise(F.array().cast("array<bigint>")).alias("tails"), F.when(F.col("_stem"), x["s"]).alias("s"),
        )

    return rows.withColumn("_plain", plain).withColumn("_stem", ~F.col("_holder") & F.exists("_s", lambda x: x["k"] > 0)).select("_id", "_source", "_holder", "_doc", F.transform("_s", number).alias("_s"))


def _messages(rows: DataFrame, wide_docs: int, wide_sources: int, stray: float) -> DataFrame:
    """The sentences, by hash, that stand as messages: (``h``, ``k``, ``wide``).

    Exact hashes are grouped over all texts and sources in one partly combined aggregate of numbers. A wide group stands
    in at least ``wide_docs`` different texts (copies of a text are one) of ``wide_sources`` sources, told by bits of their
    hashes, and keeps to itself: of its texts at most ``stray`` have more ordinary text beside it. Wide groups with a stem
    are messages of its kind, those without are frames (``k`` 0). A group that isn't wide is a message only if it has a
    stem, never stands beside ordinary text and is terse.
    """
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(c, F.lit(63)).cast("int"))
    each = rows.select(F.explode("_s").alias("s"), bit(F.col("_doc")).alias("d"), bit(F.xxhash64("_source")).alias("r"))
    groups = each.groupBy("s.h").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("s.near")).alias("far"), F.bit_or("d").alias("d"), F.bit_or("r").alias("r"), F.max("s.k").alias("k"), F.bool_and("s.terse").alias("terse"),
    )
    wide = (F.bit_count("d") >= wide_docs) & (F.bit_count("r") >= wide_sources) & (F.col("far") <= F.col("n") * stray)
    return groups.select("h", "k", wide.alias("wide"), "terse", "far").where(F.col("wide") | ((F.col("k") > 0) & F.col("terse") & (F.col("far") == 0))).select("h", "k", "wide")


def _covered(asked: DataFrame, messages: DataFrame) -> DataFrame:
    """Sentences that hold wide messages or frames of two words or more, by hash: (``h``, ``rest``, ``ck``).

    For pages in which messages and frames follow each other on one line without a full stop. Each distinct sentence of the
    asked texts is gone through from its start, the longest first; ``rest`` is the number of its words that none covers,
    ``ck`` the kind (0: frames only). Places where one may start are found by a join on its first two words.
    """
    words = F.split("s", " ")
    pair = lambda a, b: F.xxhash64(F.btrim(F.concat_ws(" ", a, b), F.lit(TRIM)))
    lines = asked.groupBy("s.h").agg(F.min("s.s").alias("s"), F.max("s.w").alias("w"))
    lines = cut(lines.where(F.size(words) > 1).join(messages.where("wide").select("h", "k"), "h", "left"))
    units = lines.where("k is not null").select(pair(words[0], words[1]).alias("first"), F.col("h").alias("unit"), F.size(words).alias("n"), F.col("w").alias("uw"), "k")
    lines = lines.where("k is null and size(split(s, ' ')) > 2").select("h", "w", words.alias("words"))
    starts = lines.select("h", F.posexplode(F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), pair)).alias("at", "first"))
    spans = starts.join(units, "first").groupBy("h").agg(F.collect_list(F.struct("at", (-F.col("n")).alias("longest"), "n", "unit", "uw", "k")).alias("spans"))
    held = F.filter("spans", lambda x: F.xxhash64(F.btrim(F.array_join(F.slice("words", x["at"] + 1, x["n"]), " "), F.lit(TRIM))) == x["unit"])
    kind = lambda a, b: F.when(a == 0, b).when(b == 0, a).otherwise(F.least(a, b))
    step = lambda y, x: F.when(x["at"] < y["end"], y).otherwise(F.struct((x["at"] + x["n"]).alias("end"), (y["off"] + x["uw"]).alias("off"), kind(y["k"], x["k"]).alias("k")))
    taken = F.aggregate(F.array_sort(held), F.struct(F.lit(0).alias("end"), F.lit(0).alias("off"), F.lit(0).alias("k")), step)
    return lines.join(spans, "h").select("h", "w", taken.alias("t")).where("t.off > 0").select("h", F.greatest(F.col("w") - F.col("t.off"), F.lit(0)).alias("rest"), F.col("t.k").alias("ck"))


def residue(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    wide_docs: int = 6, wide_sources: int = 3, company: int = 24, title: int = 8, stray: float = 0.05,
) -> DataFrame:
    """Every text that is residue, with its kind: ``placeholder``, ``script``, ``filler`` or ``error``.

    Texts of any length and language are masked and cut into sentences, whose exact hashes are grouped across all texts and
    sources. Sentences that recur widely without ever standing in ordinary prose of more than ``company`` words are a site's
    messages and page frames; the kind of a message comes from generic stems. Sentences that don't recur widely count only
    if they have a stem, are terse, report nothing and never stand in prose. Wide messages and frames are also known inside
    a sentence, where a page's lines were joined. A text is residue if it has a message and, all
    messages and frames taken off, at most ``title`` words are left. A placeholder counts anywhere in prose outside code,
    quotations and sentences about placeholders. Null, empty and blank texts are never residue; one row an id, whatever
    repeated rows there are; null ids have no row; a null source is one source; other columns are ignored.

    The texts are gone through once; from then on only numbers travel. Only texts with a stem are looked up again.
    """
    rows = cut(_sentences(documents, id_col, text_col, source_col, company, title))
    messages = cut(_messages(rows, wide_docs, wide_sources, stray))
    asked = rows.where(~F.col("_holder") & F.exists("_s", lambda s: s["k"] > 0)).select("_id", F.col("_doc").alias("_row"), F.posexplode("_s").alias("at", "s"))
    whole = F.array(F.struct(F.col("s.h").alias("h"), F.lit(0).alias("off")))
    tails = F.transform("s.tails", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("off")))
    looked = asked.select("_id", "_row", "at", F.col("s.w").alias("w"), F.explode(F.concat(whole, tails)).alias("c")).select("_id", "_row", "at", "w", "c.*")
    looked = looked.join(messages, "h", "left")
    hit = F.when(F.col("k").isNotNull() & (F.col("wide") | (F.col("off") == 0)) & ((F.col("off") == 0) | (F.col("k") > 0)), F.struct((-F.col("off")).alias("off"), F.col("k")))
    best = looked.groupBy("_id", "_row", "at").agg(F.max(hit).alias("hit"), F.max("w").alias("w"), F.max(F.when(F.col("off") == 0, F.col("h"))).alias("h"))
    best = best.join(_covered(asked, messages), "h", "left")
    left = F.least(F.coalesce(-F.col("hit.off"), F.col("w")), F.col("rest"))
    kinds = F.filter(F.array("hit.k", "ck"), lambda k: k > 0)
    judged = best.groupBy("_id", "_row").agg(F.sum(left).alias("left"), F.min(F.array_min(kinds)).alias("k"))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("k"))
    found = judged.where(F.col("k").isNotNull() & (F.col("left") <= title)).select("_id", kind.alias("kind"))
    holders = rows.where("_holder").select("_id", F.lit("placeholder").alias("kind"))
    return holders.unionByName(found).groupBy(F.col("_id").alias(id_col)).agg(F.max("kind").alias("kind"))


def message_classes(documents: DataFrame, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Masked whole texts that recur, with the number of texts and sources, widest first by count: the evidence of classes.

    Copies are counted by (hash pair, length, source) before they meet, so a group of copies of any size is one small row a
    source; texts of any length count, as the text is a value of its group and no key.
    """
    rows = documents.where(F.col(text_col).rlike(f"[^{SPACE}]"))
    line = F.trim(F.regexp_replace(masked(F.col(text_col)), r"^[#*>\-\s]+|\s+", " "))
    rows = settle(rows.select(line.alias("mask"), F.lower(F.trim(F.coalesce(F.col(source_col), F.lit("")))).alias("s")))
    key = ["hash", "_other", "_length"]
    rows = rows.select(F.xxhash64("mask").alias("hash"), F.xxhash64(F.lit(1), "mask").alias("_other"), F.length("mask").alias("_length"), "mask", "s")
    by = rows.groupBy(*key, "s").agg(F.min("mask").alias("mask"), F.count(F.lit(1)).alias("n"))
    wide = by.groupBy(*key).agg(F.min("mask").alias("mask"), F.sum("n").alias("n_texts"), F.count(F.lit(1)).alias("n_sources"))
    return wide.where("n_texts > 1").select("hash", "mask", "n_texts", "n_sources")
