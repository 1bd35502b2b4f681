"""Column expressions over text. Character offsets are code points."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import spoken

# Words that carry no content, in English and Vietnamese.
STOP_WORDS = "a an and are as at be by for from in is it of on or that the this to was with các có của được là một những theo trong và".split()
# English number words and their digits.
NUMBER_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10", "eleven": "11",
    "twelve": "12", "twenty": "20", "thirty": "30", "forty": "40", "fifty": "50", "sixty": "60", "seventy": "70", "eighty": "80", "ninety": "90", "hundred": "100", "thousand": "1000",
}
# Cues of question types, in the order in which they are tried.
COMPARATIVE_CUES = ["compare", "versus", " vs ", "difference", "better", "so sánh", "khác nhau", "hơn hay"]
GLOBAL_CUES = ["overall", "summarize", "main contribution", "key findings", "toàn bộ", "tổng quan", "kết luận", "đóng góp chính"]
EXPLANATORY_CUES = ["why", "how", "explain", "mechanism", "rationale", "tại sao", "như thế nào", "giải thích"]
# Negations that two statements must share.
NEGATIONS = ["no", "not", "never", "neither", "without", "none", "cannot", "can't"]
# Wording of superiority and of non-inferiority.
SUPERIORITY = r"(?i)(^|[^\p{L}\p{N}_])(tốt hơn|cao hơn|nhanh hơn|vượt|vượt trội|hơn hẳn|better|outperform)"
NON_INFERIORITY = r"(?i)(^|[^\p{L}\p{N}_])(không kém|không thua|tương đương|ngang bằng|non-inferior|not worse)"
WORD = r"[\p{L}\p{N}_]+"
SENTENCE_BREAK = r"(?<=[.!?]) (?=[A-ZÀ-Ỹ0-9(\[])"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: str | Column) -> Column:
    """Case folding: lower case, with ß as ss."""
    return F.replace(F.lower(col(c)), F.lit("ß"), F.lit("ss"))


def normalize_ws(c: str | Column) -> Column:
    """White-space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def strip(c: str | Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def words(c: str | Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_extract_all(col(c), F.lit(f"({WORD})"), F.lit(1))


def content_tokens(c: str | Column) -> Column:
    """Folded words of two characters or more without stop words."""
    return F.filter(F.transform(F.filter(words(c), lambda w: F.length(w) > 1), fold), lambda w: ~w.isin(STOP_WORDS))


def canonical_tokens(c: str | Column) -> Column:
    """Content tokens with number words as digits."""
    digits = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    return F.transform(content_tokens(c), lambda w: F.coalesce(F.try_element_at(digits, w), w))


def token_set(c: str | Column) -> Column:
    return F.array_distinct(content_tokens(c))


def sentences(c: str | Column) -> Column:
    """Sentences of the normalized text: cut after . ! ? where a capital, digit or opening bracket follows."""
    return sentences_of(normalize_ws(c))


def sentences_of(c: str | Column) -> Column:
    """Sentences of a text that is normalized already."""
    return F.filter(F.split(col(c), SENTENCE_BREAK), lambda s: F.length(s) > 0)


def token_estimate(c: str | Column) -> Column:
    """A model's token count, estimated at 1.25 a word, 1 at least."""
    return F.greatest(F.lit(1), F.ceil(F.regexp_count(col(c), F.lit(WORD)) * 1.25)).cast("int")


def overlap(q: Column, t: Column) -> Column:
    """Share of the query's token set in the text's; both token arrays."""
    return F.coalesce(F.size(F.array_intersect(q, t)) / F.nullif(F.size(F.array_distinct(q)), F.lit(0)), F.lit(0.0))


def density(q: Column, t: Column) -> Column:
    """Matching tokens of the text over the square root of its length, 1 at most."""
    hits = F.size(F.filter(t, lambda w: F.array_contains(q, w)))
    return F.when((F.size(q) == 0) | (F.size(t) == 0), 0.0).otherwise(F.least(F.lit(1.0), hits / F.greatest(F.lit(1.0), F.sqrt(F.size(t)))))


def jaccard(a: Column, b: Column) -> Column:
    """Set ratio of two arrays, 0 if both are empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def containment(inner: Column, outer: Column) -> Column:
    return F.coalesce(F.size(F.array_intersect(inner, outer)) / F.nullif(F.size(F.array_distinct(inner)), F.lit(0)), F.lit(0.0))


def normalize_answer(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(c)), r"\s+", " "))


def normalize_squad_answer(c: str | Column) -> Column:
    """Lower case without ASCII punctuation and articles."""
    bare = F.regexp_replace(F.lower(col(c)), r"[!-/:-@\[-`{-~]", "")
    return normalize_ws(F.regexp_replace(bare, r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])", " "))


def classify_query(c: str | Column) -> Column:
    """Question type by the first list with a cue in the text."""
    low = F.concat(F.lit(" "), F.lower(col(c)), F.lit(" "))
    has = lambda cues: F.greatest(*[F.contains(low, F.lit(x)) for x in cues])
    causal = low.rlike(r"(?s)(^|[^\p{L}\p{N}_])(what|which)([^\p{L}\p{N}_].*[^\p{L}\p{N}_]|[^\p{L}\p{N}_])(result|lead|cause|effect)([^\p{L}\p{N}_]|$)")
    return F.when(has(COMPARATIVE_CUES), "comparative_multi_hop").when(has(GLOBAL_CUES), "global_synthesis").when(has(EXPLANATORY_CUES) | causal, "explanatory").otherwise("factoid")


def stable_id(*parts: Column) -> Column:
    """20 hex digits of the SHA-1 of the parts joined by |."""
    return F.substring(F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 20)


def context_key(*parts: Column) -> Column:
    """SHA-256 over parts each ended by NUL."""
    return F.sha2(F.concat(*[F.concat(p.cast("string"), F.lit("\0")) for p in parts]), 256)


def numbers_in(c: str | Column) -> Column:
    """The different numbers of a text, spoken ones too: dotted thousands joined, decimal commas as points, outer zeros gone."""

    def canonical(raw: Column) -> Column:
        value = F.when(raw.rlike(r"^\d{1,3}(\.\d{3})+$"), F.replace(raw, F.lit("."), F.lit(""))).otherwise(F.replace(raw, F.lit(","), F.lit(".")))
        whole = F.regexp_replace(value, "^0+", "")
        return F.when(F.contains(value, F.lit(".")), F.regexp_replace(F.regexp_replace(value, "0+$", ""), r"\.+$", "")).otherwise(F.when(whole == "", "0").otherwise(whole))

    return F.array_distinct(F.transform(F.regexp_extract_all(spoken.digits_from_number_words(col(c)), F.lit(r"(\d+(?:[.,]\d+)*)"), F.lit(1)), canonical))


def number_list(c: str | Column) -> Column:
    """All numbers of a text in compatibility forms (:func:`spoken.nfkc`), language-neutral: spaces, commas and points before groups of three digits are thousands."""
    joined = F.regexp_replace(col(c), r"(?<=\d)[   ](?=\d{3}(?!\d))", "")

    def canonical(raw: Column) -> Column:
        thousands = raw.rlike(r"^\d{1,3}([.,]\d{3})+$") & ~raw.rlike(r"^0[.,]\d{3}$")
        digits = F.regexp_replace(raw, "[.,]", "")
        value = F.when(thousands, digits).when(raw.rlike(r"^\d+[.,]\d+$"), F.replace(raw, F.lit(","), F.lit("."))).otherwise(digits)
        value = F.when(F.contains(value, F.lit(".")), F.regexp_replace(F.regexp_replace(value, "0+$", ""), r"\.$", "")).otherwise(value)
        bare = F.regexp_replace(value, "^0+", "")
        return F.when(bare == "", "0").otherwise(bare)

    return F.transform(F.regexp_extract_all(joined, F.lit(r"(\d+(?:[.,]\d+)*)"), F.lit(1)), canonical)


def counted(items: Column) -> Column:
    """A sorted array of (item, times)."""
    return F.array_sort(F.transform(F.array_distinct(items), lambda x: F.struct(x.alias("item"), F.size(F.filter(items, lambda y: y == x)).alias("n"))))


def multiset_overlap(a: Column, b: Column) -> Column:
    """How many items of ``a`` have a partner in ``b``."""
    times = lambda items, x: F.size(F.filter(items, lambda y: y == x))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(times(a, x), times(b, x)))


def claim_coverage(claim: Column, evidence: Column) -> Column:
    """Share of the claim's canonical tokens, as a multiset, found in the evidence's."""
    return F.coalesce(multiset_overlap(claim, evidence) / F.nullif(F.size(claim), F.lit(0)), F.lit(0.0))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two token multisets; 0 without common tokens."""
    common = multiset_overlap(a, b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (common == 0), 0.0).otherwise(2.0 * common / (F.size(a) + F.size(b)))


def spaced_tokens(c: str | Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(col(c), r"\s+", " ")), " "), lambda w: w != "")


def translation_flags(source: str | Column, target: str | Column) -> Column:
    """``empty`` and ``numbers_changed`` for a translated segment; both texts in compatibility forms."""
    a, b = number_list(source), number_list(target)
    matters = lambda items: counted(F.filter(items, lambda v: F.contains(v, F.lit(".")) | (F.length(v) >= 2)))
    more = F.size(b) > multiset_overlap(b, a)
    return F.array_compact(F.array(F.when(F.trim(F.regexp_replace(col(target), r"\s", "")) == "", "empty"), F.when((matters(a) != matters(b)) | more, "numbers_changed")))


def claim_guard(claim: str | Column, evidence: str | Column) -> Column:
    """Why a claim is refused: a number that the evidence lacks, or superiority where it states non-inferiority only."""
    claim, evidence = col(claim), col(evidence)
    over = claim.rlike(SUPERIORITY) & evidence.rlike(NON_INFERIORITY) & ~evidence.rlike(SUPERIORITY) & ~claim.rlike(NON_INFERIORITY)
    return F.when(F.size(F.array_except(numbers_in(claim), numbers_in(evidence))) > 0, "number_not_in_evidence").when(over, "non_inferiority_overclaimed")


def lexical_conflict(claim: str | Column, evidence: str | Column) -> Column:
    """Whether only one of the two is negated, or both have numbers and share none."""
    negated = lambda c: F.arrays_overlap(F.transform(spaced_tokens(c), fold), F.array(*map(F.lit, NEGATIONS)))
    figures = lambda c: F.regexp_extract_all(col(c), F.lit(r"(?<![\p{L}\p{N}_])(\d+(?:\.\d+)?%?)(?![\p{L}\p{N}_])"), F.lit(1))
    a, b = figures(claim), figures(evidence)
    return (negated(claim) != negated(evidence)) | ((F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b))


def normalize_transcript(c: str | Column) -> Column:
    """Compatibility forms in lower case, thousands joined, punctuation and symbols as spaces, % as a word of its own."""
    joined = F.regexp_replace(F.lower(spoken.nfkc(col(c))), r"(?<=\d)[.,](?=\d{3}(?!\d))", "")
    return normalize_ws(F.replace(F.regexp_replace(joined, r"[\p{P}\p{S}&&[^%]]", " "), F.lit("%"), F.lit(" % ")))


def video_id(c: str | Column) -> Column:
    """The 11 characters of a video in the known forms of links, or null."""
    url = col(c)
    shapes = [r"^([A-Za-z0-9_-]{11})$", r"^https?://(?:www\.|m\.)?youtube\.com/watch\?(?:[^#]*&)?v=([A-Za-z0-9_-]{11})(?:[&#]|$)", r"^https?://youtu\.be/([A-Za-z0-9_-]{11})(?:[?#/]|$)", r"^https?://(?:www\.|m\.)?youtube\.com/(?:shorts|embed|live)/([A-Za-z0-9_-]{11})(?:[?#/]|$)"]
    return F.coalesce(*[F.nullif(F.regexp_extract(url, s, 1), F.lit("")) for s in shapes])


def word_chunks(c: str | Column, size: int) -> Column:
    """Consecutive chunks of ``size`` words; an empty text gives one empty chunk."""
    w = spaced_tokens(c)
    n = F.greatest(F.lit(1), F.ceil(F.size(w) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(w, i * size + 1, size), " "))


def truncate_to_tokens(c: str | Column, tokens: Column) -> Column:
    """The first sentences within a budget of estimated tokens; of a first one that is too long the first words."""
    text, limit = col(c), F.greatest(F.lit(4), F.floor(tokens / 1.25)).cast("int")
    parts = sentences(text)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("total"), F.lit(True).alias("open"))

    def take(s: Column, part: Column) -> Column:
        size = F.regexp_count(part, F.lit(WORD))
        fits = s["open"] & (s["total"] + size <= limit)
        return F.struct((s["n"] + fits.cast("int")).alias("n"), (s["total"] + F.when(fits, size).otherwise(0)).alias("total"), fits.alias("open"))

    kept = F.aggregate(parts, start, take, lambda s: s["n"])
    some = lambda t: F.array_join(F.slice(words(t), F.lit(1), limit), " ")
    return F.when(token_estimate(text) <= limit * 1.25, text).when(kept > 0, F.array_join(F.slice(parts, F.lit(1), kept), " ")).when(F.size(parts) > 0, some(F.get(parts, 0))).otherwise(some(text))


def truncate_to_fit(c: str | Column, tokens: Column) -> Column:
    """Cut at a sentence, then at a word, so that the estimate never passes the budget."""
    cut = truncate_to_tokens(c, tokens)
    most = F.least(F.size(words(cut)) - 1, F.floor(tokens / 1.25).cast("int"))
    return F.when((cut == "") | (token_estimate(cut) <= tokens), cut).when(most >= 1, F.array_join(F.slice(words(cut), F.lit(1), F.greatest(most, F.lit(1))), " ")).otherwise("")
