"""Scalar text functions as Column expressions: cleaning, normalising, counting, flags and similarity.

They stay inside the JVM; only NFKC (``nfkc``) has no built-in counterpart and runs as an Arrow-batched UDF.
Regular expressions use ASCII classes, so that the same pattern means the same in other SQL engines.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quotes, dashes and primes, and what they become.
QUOTES = {"\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201b": "'", "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u2013": "-", "\u2014": "-", "\u2032": "'", "\u2033": '"'}
#: Phrases that rewriting tools leave behind.
TRANSITION_PHRASES = (
    "in addition", "furthermore", "notably", "it is worth", "as a result", "overall", "additionally", "thus", "delve", "testament", "pivotal",
    "underscores", "tapestry", "moreover", "seamlessly", "consequently", "paramount", "realm", "beacon", "thorough framework",
    "serves as proof", "complex challenges", "play a key role", "plays a key role", "empirical evaluations demonstrate",
    "increasingly focused on", "as has been shown", "gradient descent methods", "generalization performance", "synergistic optimization",
    "key challenges", "objective function", "empirical risk minimization", "important importance", "future research into",
    "crucial framework", "mitigating oxidative stress", "in modern oncology", "therapeutic efficacy", "clinical trials have",
    "play a pivotal role", "in modern quantum physics", "mitigating phase noise", "active phase stabilization",
    "error rate scales linearly", "in modern macroeconomics", "in applied econometrics", "stochastic general equilibrium",
    "nominal rigidities", "adaptive fiscal intervention", "in summary", "taken together",
)
#: Words and phrases that language models favour, and whose they are.
SIGNATURES = dict.fromkeys(("delve", "testament", "tapestry", "pinnacle", "dynamic", "multifaceted", "landscape", "holistic", "furthermore", "moreover"), "Claude") | dict.fromkeys(("crucial", "leverage", "rapidly evolving", "demystify", "game-changer", "transition", "remember", "in summary", "overall"), "GPT")
#: Strings that give a text away.
MARKERS = ("large language model", "generated by", "autoencoder", "artificial intelligence", "convolutional", "gpt", "gemini", "claude")
#: English function words, which tell no topic.
STOP_WORDS = tuple("""i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from
up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not
only own same so than too very can will just should now""".split())
#: Section categories in the order they are tried, their labels and patterns; case does not matter.
HEADINGS = (
    ("ABSTRACT", "Abstract & Keywords", r"^(?:abstract|executive summary|keywords|index terms)\b"),
    ("INTRO", "1. Introduction & Background", r"^(?:1\.?|I\.?|section 1)?\s*(?:introduction|background|motivation|problem statement)\b"),
    ("LIT_REVIEW", "2. Literature Review & Related Work", r"^(?:2\.?|II\.?|section 2)?\s*(?:related work|literature review|literature survey|prior work|state of the art)\b"),
    ("METHODOLOGY", "3. Proposed Methodology & Design", r"^(?:3\.?|III\.?|section 3)?\s*(?:methodology|proposed method|system model|architecture|materials and methods|theoretical framework|approach|study area)\b"),
    ("RESULTS", "4. Experimental Results & Evaluation", r"^(?:4\.?|IV\.?|section 4)?\s*(?:experimental setup|experiments|results|performance evaluation|comparative study|implementation|water balance)\b"),
    ("DISCUSSION", "5. Discussion & Limitations", r"^\s*(?:5\.?|V\.?|section 5)?\s*(?:discussion|limitations|threats to validity|ablation study)\b"),
    ("CONCLUSION", "6. Conclusion & Future Work", r"^\s*(?:6\.?|VI\.?|section 6)?\s*(?:conclusion|concluding remarks|future work|summary)\b"),
    ("REFERENCES", "7. References & Bibliography", r"^\s*(?:7\.?|VII\.?|section 7)?\s*(?:references|bibliography|works cited|appendix)\b"),
)
#: Lower-cased lines that name places, addresses and dates.
METADATA_LINE = r"^\s*(?:independent research|university|department|school|e-mail|email|july \d{4}|june \d{4}|august \d{4}|january \d{4}|february \d{4}|march \d{4}|april \d{4}|may \d{4}|september \d{4}|october \d{4}|november \d{4}|december \d{4})\s*$"
#: Sources of the academic and the question domain; all others are essays.
ACADEMIC = ("human", "anthropic/claude-haiku-4.5", "google/gemini-3-flash-preview", "openai/gpt-5-nano", "gpt-oss-120b", "openai/gpt-oss-20b")
QUESTIONS = ("hc3_human", "hc3_chatgpt")
#: What a source's name holds and the generator it means, in the order they are tried.
GENERATORS = (("claude", "Claude"), ("gemini", "Gemini"), ("gpt-5", "GPT-5"), ("gpt5", "GPT-5"), ("llama", "Llama"), ("chatgpt", "ChatGPT"), ("chat_gpt", "ChatGPT"), ("gpt-oss", "GPT-OSS-120B"), ("mistral", "Mistral"), ("palm", "PaLM"), ("falcon", "Falcon"), ("command", "Command"), ("human", "Human"), ("persuade", "Human"))
#: The same for studies that leave generators out, for retraining and for the breakdown of recall.
GENERATORS_LEFT_OUT = (("claude", "Claude"), ("gemini", "Gemini"), ("gpt-5", "GPT-5"), ("gpt5", "GPT-5"), ("gpt-oss-120b", "GPT-OSS-120B"), ("gpt-oss-20b", "GPT-OSS-120B"), ("chatgpt", "ChatGPT"), ("chat_gpt", "ChatGPT"), ("llama", "Llama"))
GENERATORS_RETRAINED = (("claude", "claude"), ("gemini", "gemini"), ("gpt-5", "gpt-5"), ("gpt5", "gpt-5"), ("llama", "llama"), ("chatgpt", "chatgpt"), ("chat_gpt", "chatgpt"))
GENERATORS_RECALLED = (("claude", "Claude"), ("gemini", "Gemini"), ("gpt-5", "GPT-5"), ("llama", "Llama"), ("chatgpt", "ChatGPT"), ("chat_gpt", "ChatGPT"))
WORD = "[A-Za-z0-9_]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nfkc(c) -> Column:
    """Unicode NFKC. Python takes a hundred texts at a time, however many a task has."""
    return F.udf(lambda x: None if x is None else unicodedata.normalize("NFKC", x), "string", useArrow=False)(_c(c))


def strip_controls(c) -> Column:
    return F.regexp_replace(_c(c), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]", "")


def strip_tags(c) -> Column:
    return F.regexp_replace(_c(c), "<[^>]+>", " ")


def plain_quotes(c) -> Column:
    return F.translate(_c(c), "".join(QUOTES), "".join(QUOTES.values()))


def strip_markdown(c) -> Column:
    """Headers, emphasis marks, links to their label, fenced and inline code, in that order."""
    out = F.regexp_replace(_c(c), "(?m)^#{1,6}\\s+", "")
    out = F.regexp_replace(out, "\\*\\*|__|\\*|_", "")
    out = F.regexp_replace(out, "\\[([^\\]]+)\\]\\([^)]+\\)", "$1")
    out = F.regexp_replace(out, "(?s)```.*?```", "")
    return F.regexp_replace(out, "`([^`]+)`", "$1")


def tidy_space(c) -> Column:
    """CRLF to LF, runs of blanks to one space, three or more line ends to two, trimmed."""
    out = F.regexp_replace(_c(c), "\\r\\n", "\n")
    out = F.regexp_replace(out, "[ \\t\\x{A0}\\x{2000}-\\x{200A}]+", " ")
    out = F.regexp_replace(out, "\\n{3,}", "\n\n")
    return strip(out)


def strip(c) -> Column:
    return F.regexp_replace(_c(c), "^\\s+|\\s+$", "")


def clean(c, with_nfkc: bool = False) -> Column:
    """The cleaning chain: (NFKC,) controls, quotes, tags, markdown, white space; a null becomes empty."""
    out = F.coalesce(_c(c), F.lit(""))
    if with_nfkc:
        out = nfkc(out)
    return tidy_space(strip_markdown(strip_tags(plain_quotes(strip_controls(out)))))


def topic(c) -> Column:
    """Only ASCII letters, digits and single underscores, 64 characters at most."""
    out = F.regexp_replace(strip(F.regexp_replace(F.lower(F.coalesce(_c(c), F.lit(""))), "[^a-z0-9\\s]", "")), "\\s+", "_")
    return F.when(out == "", "unknown_topic").otherwise(F.substring(out, 1, 64))


def words(c) -> Column:
    """What white space separates."""
    return F.filter(F.split(_c(c), "\\s+"), lambda w: w != "")


def n_words(c) -> Column:
    return F.size(words(c)).cast("long")


def hash_topic(c) -> Column:
    """A stand-in topic from the first ten words."""
    first = F.array_join(F.slice(words(F.lower(_c(c))), 1, 10), " ")
    return F.when(first == "", "empty_text_hash").otherwise(F.concat(F.lit("hash_"), F.substring(F.sha2(first, 256), 1, 16)))


def short_id(c) -> Column:
    return F.substring(F.md5(_c(c)), 1, 16)


def n_tokens(c) -> Column:
    """Words times 1.33, rounded down."""
    return F.floor(n_words(c) * F.lit(133) / F.lit(100)).cast("long")


def bucket(c, n: int) -> Column:
    """A number below n from the md5 of a string: a stable stand-in for a random draw."""
    return F.pmod(F.conv(F.substring(F.md5(_c(c)), 1, 8), 16, 10).cast("long"), F.lit(n))


def has_transition(c) -> Column:
    return F.lower(_c(c)).rlike("\\b(" + "|".join(TRANSITION_PHRASES) + ")\\b")


def is_metadata(c) -> Column:
    return F.lower(_c(c)).rlike(METADATA_LINE)


def has_marker(c) -> Column:
    low = F.lower(_c(c))
    out = F.lit(False)
    for m in MARKERS:
        out = out | F.contains(low, F.lit(m))
    return out


def domain(source) -> Column:
    return F.when(_c(source).isin(*ACADEMIC), "academic").when(_c(source).isin(*QUESTIONS), "qa").otherwise("essay")


def generator(source, names: tuple = GENERATORS, other: str | None = "Other_AI") -> Column:
    return F.coalesce(*[F.when(F.contains(F.lower(_c(source)), F.lit(k)), F.lit(v)) for k, v in names], F.lit(other))


def generator_by_label(source, label) -> Column:
    """The generator for studies that leave one out; a text of label 0 is a human's."""
    return F.when(_c(label) == 0, "human").otherwise(generator(source, GENERATORS_LEFT_OUT))


def generators_recalled(source) -> Column:
    """Every generator of the recall breakdown that a source's name holds; it may be several."""
    low, names = F.lower(_c(source)), dict.fromkeys(v for _, v in GENERATORS_RECALLED)
    holds = lambda n: F.greatest(*[F.contains(low, F.lit(k)) for k, v in GENERATORS_RECALLED if v == n], F.lit(False))
    return F.filter(F.array(*[F.when(holds(n), F.lit(n)) for n in names]), lambda x: x.isNotNull())


#: A fixed value: a numbered heading of a name of its own.
OWN_HEADING = r"^([0-9]+\.?[0-9]*|[IVXLCDM]+\.)\s+[A-Z][a-zA-Z\s]{2,40}"


def heading(c, labels: bool = False) -> Column:
    """The category of a heading, or its label; null if the first 80 characters are none."""
    head = strip(F.substring(strip(_c(c)), 1, 80))
    general = F.lit("GENERAL_SECTION") if not labels else strip(F.substring(head, 1, 45))
    out = F.when(head.rlike(OWN_HEADING), general)
    for category, label, pattern in reversed(HEADINGS):
        out = F.when(head.rlike(f"(?i){pattern}"), F.lit(label if labels else category)).otherwise(out)
    # hardly any sentence is a heading: one pattern of all tells that
    return F.when(head.rlike("(?i)^(?:" + "|".join(p.removeprefix("^") for p in (*(p for _, _, p in HEADINGS), OWN_HEADING)) + ")"), out)


def heading_title(c) -> Column:
    """A heading up to its first line end, colon or full stop; its label if that is too short to tell."""
    first = strip(F.split(strip(F.substring(strip(_c(c)), 1, 80)), "[\\n:.]")[0])
    return F.when((heading(c) != "GENERAL_SECTION") & (F.length(first) > 2), first).otherwise(heading(c, labels=True))


def tier(c, high: float = 0.75, medium: float = 0.60) -> Column:
    return F.when(_c(c) >= high, "HIGH").when(_c(c) >= medium, "MEDIUM").otherwise("LOW")


def risk(percent) -> Column:
    return F.when(_c(percent) >= 65, "HIGH").when(_c(percent) >= 45, "MEDIUM").otherwise("LOW")


def diversity_label(c) -> Column:
    return F.when(_c(c) >= 68, "HIGH").when(_c(c) >= 58, "MEDIUM").otherwise("LOW")


def burstiness_label(c) -> Column:
    return F.when(_c(c) >= 45, "HIGH").when(_c(c) >= 30, "MEDIUM").otherwise("LOW")


def doi(c) -> Column:
    """The first DOI without punctuation at its end, or null."""
    found = F.regexp_replace(F.regexp_extract(_c(c), r"\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)", 1), r"[.,;)\]}]+$", "")
    return F.when(found != "", found)


#: What an alignment key leaves out.
ALIGN_MARKS = "\"'.,/#!$%^&*;:{}=-_`~()[]"
ALIGN_DROPPED = "[\\s\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{200B}-\\x{200D}\\x{FEFF}\\x{2010}-\\x{2015}\\x{201C}\\x{201D}\\x{2018}\\x{2019}" + "".join(f"\\{m}" for m in ALIGN_MARKS) + "]"


def align_key(c) -> Column:
    """Lower case without white space, zero-width characters, dashes, quotes and the ALIGN_MARKS."""
    return F.lower(F.regexp_replace(_c(c), ALIGN_DROPPED, ""))


def token_set(c) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(_c(c)), F.lit(f"({WORD})"), 1))


def similarity(a, b) -> Column:
    """0.7 times the Jaccard similarity of words plus 0.3 times the ratio of lengths; 1.0 if either has none."""
    x, y = token_set(a), token_set(b)
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    la, lb = F.length(_c(a)), F.length(_c(b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(1.0)).otherwise(F.round(F.lit(0.7) * both / F.greatest(either, F.lit(1)) + F.lit(0.3) * F.least(la, lb) / F.greatest(la, lb, F.lit(1)), 4))


def protected(c) -> Column:
    """Acronyms, names with years and percentages, each once."""
    return F.array_distinct(F.regexp_extract_all(_c(c), F.lit(r"((?<![A-Za-z0-9_])[A-Z]{2,}(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])[A-Z][a-z]+ \d{4}(?![A-Za-z0-9_])|\d+(?:\.\d+)?%)"), 1))


def safe_name(c) -> Column:
    return F.regexp_replace(_c(c), "[^A-Za-z0-9._-]+", "_")


def sigmoid(c) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(_c(c), F.lit(25.0)), F.lit(-25.0))))


def logit(p) -> Column:
    q = F.greatest(F.least(_c(p), F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.ln(q / (1 - q))


def interpolate(p, grid: Column) -> Column:
    """The value at p of a curve given at 0.00, 0.01, ..., 1.00."""
    x = F.greatest(F.least(_c(p), F.lit(1.0)), F.lit(0.0)) * 100
    k = F.least(F.floor(x), F.lit(99)).cast("int")
    return F.element_at(grid, k + 1) + (x - k) * (F.element_at(grid, k + 2) - F.element_at(grid, k + 1))


def sentences(c) -> Column:
    """What ends in . ! or ? and white space."""
    return F.split(_c(c), "(?<=[.!?])\\s+")


def word_list(c) -> Column:
    """The runs of ASCII letters, digits and underscores, in lower case."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(f"({WORD})"), 1)


def shingles_of(w, k: int = 3) -> Column:
    """The distinct runs of k elements of an array; its elements if there are fewer. The array is zipped with
    itself, shifted, and so is read k times and not once for each run."""
    w = _c(w)
    runs = w
    for j in range(1, k):
        runs = F.zip_with(runs, F.slice(w, j + 1, F.size(w)), lambda a, b: F.concat_ws(" ", a, b))
    runs = F.slice(runs, F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(0)))
    return F.array_distinct(F.when(F.size(w) >= k, runs).otherwise(w))


def shingle_hashes(w, k: int = 3) -> Column:
    """The 64-bit hashes of ``shingles_of`` an array: joins on them move eight bytes for each. The words' hashes are made
    once and named in an array of one, over which the runs are read."""
    def runs(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
        return F.when(F.size(h) >= k, many).otherwise(h)

    one = F.transform(_c(w), lambda x: F.xxhash64(x))
    return F.array_distinct(F.element_at(F.transform(F.array(one), runs), 1))


def shingles(c, k: int = 3) -> Column:
    """The distinct runs of k words, without punctuation; the words themselves if there are fewer."""
    return shingles_of(word_list(c), k)


# --- token locking: a map of placeholders, which only imperative code can number in order ---

LOCKS = (r"\$[^$]+\$", r"\\[a-zA-Z]+\{[^}]*\}", r"\[\d+(?:[,\-–]\s*\d+)*\]", r"\([A-Z][A-Za-z]+(?: et al\.)?,? \d{4}\)", r"\b\d+(?:\.\d+)?%", r"\b[A-Z]{2,}\b")
#: What is kept of a LaTeX text, in the order it is taken.
TEX_LOCKS = (
    r"\\begin\{thebibliography\}[\s\S]*?\\end\{thebibliography\}",
    r"^[\s\S]*?\\begin\{document\}",
    r"\\begin\{(?:equation|align|eqnarray|gather|math)\*?\}[\s\S]*?\\end\{(?:equation|align|eqnarray|gather|math)\*?\}",
    r"\$\$[\s\S]*?\$\$",
    r"\$[^$\n]+\$",
    r"\\begin\{table\*?\}[\s\S]*?\\end\{table\*?\}",
    r"\\begin\{tabular\*?\}[\s\S]*?\\end\{tabular\*?\}",
    r"\\begin\{figure\*?\}[\s\S]*?\\end\{figure\*?\}",
    r"\\includegraphics(?:\[.*?\])?\{.*?\}",
    r"\\cite(?:p|t|author|year)?\*?\{.*?\}",
    r"\\(?:eq)?ref\{.*?\}",
    r"\\label\{.*?\}",
    r"\\(?:newcommand|def|renewcommand)\{.*?\}",
    r"\\(?:begin|end)\{(?:abstract|IEEEkeywords|center|quote|itemize|enumerate|listing)\}",
    r"\\item(?:\s*\[.*?\])?",
    r"\\(?:section|subsection|subsubsection|paragraph|subparagraph)\*?\{.*?\}",
    r"\\IEEEPARstart\{.*?\}\{.*?\}",
    r"\\maketitle",
    r"\\(?:textit|textbf|emph|texttt|textsl|textsc)\{.*?\}",
)


def lock_text(text: str | None, patterns=LOCKS, nested: bool = False) -> tuple[str, dict[str, str]]:
    """``text`` with what must not change replaced by numbered placeholders, and what they stand for.

    Patterns are tried in order; a place that an earlier one took is left to it. ``nested``: each pattern reads
    what the ones before it left, so a block is taken as a whole, with the placeholders inside it. A full stop
    crosses no line.
    """
    text = text or ""
    if nested:
        inside: dict[str, str] = {}

        def put(m: re.Match) -> str:
            if not m[0]:
                return ""
            name = f"__LOCK_{len(inside)}__"
            inside[name] = m[0]
            return name

        for p in patterns:
            text = re.sub(p, put, text)
        return text, inside
    taken: list[tuple[int, int]] = []
    mask = bytearray(len(text))
    for p in patterns:
        for m in re.finditer(p, text):
            a, b = m.span()
            if b > a and mask.find(1, a, b) < 0:
                taken.append((a, b))
                mask[a:b] = b"\x01" * (b - a)
    out, held, at = [], {}, 0
    for k, (a, b) in enumerate(sorted(taken)):
        name = f"__LOCK_{k}__"
        held[name] = text[a:b]
        out += [text[at:a], name]
        at = b
    return "".join([*out, text[at:]]), held


def restore_text(text: str, held: dict[str, str]) -> str:
    """``text`` with its placeholders put back, the last first, as it may hold earlier ones."""
    for name, was in sorted(held.items(), key=lambda x: -int(x[0].strip("_").rpartition("_")[2])):
        text = text.replace(name, was)
    return text


def locked(c, patterns=LOCKS, nested: bool = False) -> Column:
    """A struct (text, held) of ``lock_text``. Python takes a hundred texts at a time, however many a task has."""
    return F.udf(lambda x: lock_text(x, patterns, nested), "text string, held map<string,string>", useArrow=False)(_c(c))


def restored(text, held) -> Column:
    """``text`` with its placeholders put back, by expressions only; the last first, as it may hold earlier ones."""
    number = lambda e: F.regexp_extract(e["key"], r"(\d+)", 1).cast("int")
    pairs = F.array_sort(F.map_entries(_c(held)), lambda a, b: number(b) - number(a))
    return F.aggregate(pairs, _c(text), lambda t, e: F.replace(t, e["key"], e["value"]))


def locks_intact(text, held) -> Column:
    """Whether every locked string stands in ``text``."""
    return F.forall(F.map_values(_c(held)), lambda v: F.contains(_c(text), v))


def repair_tex(c) -> Column:
    """Common slips of generated LaTeX: a lost backslash before item, begin or end, doubled dollars in a line,
    an unescaped ampersand or percent sign between words."""
    out = F.regexp_replace(_c(c), r"(?m)^(\s*)(item|begin\{|end\{)", "$1\\\\$2")
    out = F.regexp_replace(out, r"(\w) & (\w)", "$1 \\\\& $2")
    return F.regexp_replace(out, r"(\d)%", "$1\\\\%")


def mask_math(text: str | None) -> tuple[str, dict[str, str]]:
    """Formulas as placeholders, so that their full stops end no sentence."""
    return lock_text(text, (r"\$\$[\s\S]*?\$\$", r"\\\[[\s\S]*?\\\]", r"\\\([\s\S]*?\\\)", r"\$[^$]+\$"))
