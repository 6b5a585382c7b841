"""Text expressions: cleaning, second-pass preparation, tokens."""
from functools import reduce

from pyspark.sql import Column, SparkSession, functions as F

# The cleaning rules, applied in this order to the lower-cased text.
CLEANING_RULES = (
    (r"(https?://\S+|www\.\S+)", " "),   # links
    (r"(?<!\w)@\w+", " "),               # mentions
    (r"^\s*rt\b\s*:?\s*", ""),           # what is left of a leading "RT @user:"
    (r"&amp;", "&"),                     # HTML entity
    (r"#(\w+)", "$1"),                   # hashtag keeps its word
    (r"([!?.])\1+", "$1"),               # runs of punctuation
    (r"\s+", " "),                       # runs of whitespace
)
# Every match of a rule holds one of these, so a text without them skips the rule; a rule without marks always runs.
RULE_MARKS = (("://", "www."), ("@",), (), ("&amp;",), ("#",), ("!!", "??", ".."), ("  ", "\t", "\n", "\x0b", "\f", "\r"))

# Words never counted as keywords.
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up", "about",
    "into", "over", "after", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does",
    "did", "can", "could", "will", "would", "shall", "should", "may", "might", "must", "it", "its", "it's", "this",
    "that", "these", "those", "i", "you", "he", "she", "we", "they", "me", "him", "her", "us", "them", "my", "your",
    "his", "our", "their", "what", "which", "who", "whom", "whose", "when", "where", "why", "how", "all", "any",
    "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "s", "t", "can't", "don't", "just", "now", "like", "get", "new", "one", "also", "even",
    "still", "well", "way",
)

MIN_TOKEN_LENGTH = 3
ASCII_WHITESPACE = " \t\n\x0b\f\r"
REPLACEMENT_CHARACTER = "�"


def clean_text(text: Column) -> Column:
    """The rules in order; each looks for its marks first, which costs a fraction of a search by expression."""
    def apply(column: Column, rule: tuple) -> Column:
        (pattern, replacement), marks = rule
        if not marks:
            return F.regexp_replace(column, pattern, replacement)
        # The one-element array names the text, which the test and both branches use.
        return F.transform(F.array(column), lambda t: F.when(
            reduce(lambda a, b: a | b, (F.contains(t, F.lit(m)) for m in marks)), F.regexp_replace(t, pattern, replacement)).otherwise(t))[0]

    return F.trim(reduce(apply, zip(CLEANING_RULES, RULE_MARKS), F.lower(text)))


def strip_whitespace(text: Column) -> Column:
    """Trim every kind of ASCII whitespace (`trim` alone removes spaces only); looks at both ends only."""
    return F.btrim(text, F.lit(ASCII_WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.length(strip_whitespace(text)) == 0


def prepare_text(text: Column) -> Column:
    """Drop replacement characters and outer whitespace; blank texts become NULL."""
    kept = strip_whitespace(F.replace(text, F.lit(REPLACEMENT_CHARACTER), F.lit("")))
    return F.when(F.length(kept) > 0, kept)


def raw_tokens(text: Column) -> Column:
    """All runs of letters and digits that are long enough; stop words and numbers among them."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"([a-z0-9]{{{MIN_TOKEN_LENGTH},}})"), F.lit(1))


def is_keyword(token: Column) -> Column:
    return ~token.isin(*STOPWORDS) & ~token.rlike(r"^[0-9]+$")


def tokenize(text: Column) -> Column:
    return F.filter(raw_tokens(text), is_keyword)


def register_sql(spark: SparkSession) -> None:
    """Expose the text and agreement expressions to SQL as Catalyst-inlined SQL functions."""
    def quoted(value: str) -> str:
        return "r'" + value + "'" if "'" not in value else 'r"' + value + '"'

    cleaned = "lower(input_text)"
    for pattern, replacement in CLEANING_RULES:
        cleaned = f"regexp_replace({cleaned}, {quoted(pattern)}, '{replacement}')"
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION clean_text(input_text STRING) RETURNS STRING "
              f"RETURN trim({cleaned})")
    words = ", ".join(quoted(w) for w in STOPWORDS)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tokenize(input_text STRING) RETURNS ARRAY<STRING> RETURN "
              "filter(regexp_extract_all(lower(input_text), '([a-z0-9]+)', 1), w -> length(w) >= "
              f"{MIN_TOKEN_LENGTH} AND w NOT IN ({words}) AND NOT w RLIKE '^[0-9]+$')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION classify_agreement"
              "(is_reference BOOLEAN, first_alarm BOOLEAN, second_alarm BOOLEAN) RETURNS STRING RETURN "
              "CASE WHEN is_reference THEN 'reference' WHEN second_alarm IS NULL THEN 'mcddd_missing' "
              "WHEN first_alarm AND second_alarm THEN 'both' WHEN first_alarm THEN 'driftlens_only' "
              "WHEN second_alarm THEN 'mcddd_only' ELSE 'neither' END")
