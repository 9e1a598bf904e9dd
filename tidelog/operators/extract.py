"""Entities, secrets and personal data in texts: extraction, redaction, suppression.

Each kind is one regular expression without look-around, so it stays in the JVM.
A secret is reported by its kind alone; its characters are in no result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shapes of secrets; only their kind is ever reported.
SECRETS = (
    ("jwt", r"\beyJ[A-Za-z0-9_=-]{8,}\.[A-Za-z0-9_=-]{8,}\.[A-Za-z0-9_=-]{4,}\b"),
    ("aws_access_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("github_pat", r"\bgh[pousr]_[A-Za-z0-9]{36,255}\b"),
    ("stripe_api_key", r"\b(?:sk|pk|rk)_(?:test|live)_[A-Za-z0-9]{24,}\b"),
    ("bitcoin_wif", r"\b[5KL][1-9A-HJ-NP-Za-km-z]{50,51}\b"),
)
#: Any of them.
SECRET = "|".join(pattern for _, pattern in SECRETS)
_SPACE = r"\s\x0B\x{85}\p{Z}"
_OPENING = rf"^|[{_SPACE}(\[{{]"
#: Shapes of entities, in the order that decides between equal spans: kind, form, what stands before, shape.
ENTITIES = (
    ("redacted_token", "cascade_redacted", "", r"\[REDACTED:[A-Z_]+\]"),
    *(("redacted_token", kind, "", pattern) for kind, pattern in SECRETS),
    ("url", "url", "", rf"\bhttps?://[^{_SPACE}<>\"')\]}}]+"),
    ("email", "email", "", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("phone", "phone", "", r"(?:\+\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}\b"),
    ("ip_address", "ipv4", "", r"\b(?:25[0-5]|2[0-4]\d|[01]?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|[01]?\d?\d)){3}\b"),
    ("ip_address", "ipv6", "", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"),
    ("crypto_address", "bech32", "", r"\b(?:bc1|tb1)[a-z0-9]{25,62}\b"),
    ("crypto_address", "base58", "", r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b"),
    ("crypto_address", "ethereum", "", r"\b0x[a-fA-F0-9]{40}\b"),
    ("crypto_address", "solana", "", r"\b[1-9A-HJ-NP-Za-km-z]{43,44}\b"),
    ("github_ref", "github_ref", _OPENING, r"#\d{1,8}\b"),
    ("uuid", "uuid", "", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"),
    ("ulid", "ulid", "", r"\b[0-9A-HJ-KM-NP-TV-Za-hj-km-np-tv-z]{26}\b"),
    ("file_path", "file_path", _OPENING, r"/(?:[A-Za-z0-9._-]+/)+[A-Za-z0-9._-]+\b"),
)
_RUN_OF_26 = r"[0-9A-Za-z]{26}"
#: What a text must hold for a shape to be in it: strings of which one, or an expression, to spare most texts the scan.
HINTS = {
    "cascade_redacted": ("[REDACTED:",),
    "jwt": ("eyJ",),
    "aws_access_key": ("AKIA", "ASIA"),
    "github_pat": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "stripe_api_key": ("_test_", "_live_"),
    "url": ("http://", "https://"),
    "email": ("@",),
    "phone": r"\d{3}",
    "ipv4": r"\d\.\d",
    "ipv6": r"[0-9a-fA-F]:[0-9a-fA-F]",
    "bech32": ("bc1", "tb1"),
    "ethereum": ("0x",),
    "github_ref": ("#",),
    "uuid": r"[0-9a-fA-F]{8}-",
    "file_path": ("/",),
    **dict.fromkeys(("bitcoin_wif", "base58", "solana", "ulid"), _RUN_OF_26),
}
#: What a sentence may leave at the end of an address.
URL_END = r"[.,;:!?)\]}]+\z"
_RUN = r"\b\d{3,4}[-\s]?\d{3,4}\b"
#: Names of issuers, and words for codes, in the rules below.
_ISSUERS = (
    r"(?:Apple\s*ID|Apple\s*Pay|iCloud|Apple\s*Card|APPLECARD|JPMORGAN\s*CHASE|JPMorgan|Chase|BofA|Bank\s+of\s+America|"
    r"WELLS\s*FARGO|Wells\s*Fargo|Capital\s*One|CapitalOne|Citi(?:bank)?|US\s*Bank|U\.S\.\s*Bank|PNC|Truist|TD\s*Bank|"
    r"Goldman\s*Sachs|Marcus|Discover|Amex|American\s*Express|Charles\s*Schwab|Schwab|Fidelity|Venmo|Cash\s*App|"
    r"PayPal|Zelle|Coinbase|Kraken|Robinhood|Ally(?:\s*Bank)?|USAA|Navy\s*Federal|Google|Microsoft|GitHub|Slack|Stripe|LinkedIn|"
    r"Twitter|X\.com|Facebook|Instagram|Google\s*Authenticator|Authy|1Password|Duo|Microsoft\s*Authenticator)"
)
_BANKS = (
    r"(?:Chase|JPMORGAN|JPMorgan|BofA|Bank\s+of\s+America|Wells\s*Fargo|WELLS\s*FARGO|Capital\s*One|CapitalOne|"
    r"Citi(?:bank)?|US\s*Bank|PNC|Truist|TD\s*Bank|Discover|Amex|American\s*Express|Charles\s*Schwab|Schwab|"
    r"Fidelity|Ally|USAA|Navy\s*Federal|Marcus|Apple\s*Card|APPLECARD)"
)
_NOTICE = (
    r"(?:Fraud\s*Alert|Did\s+you\s+(?:make\s+a\s+charge|authorize|recognize)|charge\s+for\s+\$|confirm\s+a\s+recent\s+transaction|"
    r"unusual\s+sign[-\s]?in|recent\s+transaction|Reply\s+(?:YES|NO|STOP|HELP|\d+\s*=\s*(?:YES|NO))|Reply\s+1\s*=\s*YES|sign[-\s]?in\s+attempt)"
)
_AFTER_ISSUER = (
    r"(?:verification\s+code|security\s+code|authorization\s+code|identification\s+code|one[-\s]?time\s+code|one[-\s]?time\s+access\s+code|"
    r"sign[-\s]?in\s+code|access\s+code|enroll(?:ment)?\s+code|passcode|OTP|verification|authenticate|sign[-\s]?in|verify)"
)
_RIGHT_ISSUERS = (
    r"(?:Apple|Google|Microsoft|GitHub|Slack|Stripe|LinkedIn|Twitter|X|Facebook|Instagram|Meta|"
    r"Chase|BofA|Wells\s*Fargo|Capital\s*One|Citi|Discover|PayPal|Venmo|Coinbase|Kraken|Robinhood|Marcus|Schwab)"
)
_LEFT_WORDS = (
    r"(?:verification\s+code|security\s+code|authorization\s+code|identification\s+code|one[-\s]?time\s+(?:passcode|password|code|access\s+code)|"
    r"sign[-\s]?in\s+code|access\s+code|enroll(?:ment)?\s+code|passcode|secret\s+code|temporary\s+code|reset\s+code|recovery\s+code|"
    r"account[-\s]?recovery\s+code|your\s+code|your\s+OTP|OTP)"
)
_RIGHT_WORDS = (
    r"(?:verification\s+code|security\s+code|authorization\s+code|sign[-\s]?in\s+code|access\s+code|one[-\s]?time\s+(?:passcode|password|code)|"
    r"passcode|OTP|verification|reset\s+code|recovery\s+code|secret\s+code)"
)
_LABELS = (
    r"(?:OTP|Code|Your\s+code|verification\s+code|security\s+code|access\s+code|PIN|authorization\s+code|sign[-\s]?in\s+code|"
    r"reset\s+code|recovery\s+code|one[-\s]?time\s+(?:passcode|password|code))"
)
#: Ordered rules of one-time codes and account notices; each runs on what those before it left.
RULES = (
    ("bank-notification", rf"(?i)\b{_BANKS}\b[^\n\r]*?\b{_NOTICE}\b[^\n\r]*"),
    (
        "issuer-prefix-code",
        rf"(?i)\b{_ISSUERS}\b[^.\n\r]*?\b(?:{_AFTER_ISSUER}|code|verify|verification|authenticate)\b[^.\n\r]*?{_RUN}|"
        rf"\b{_ISSUERS}\b[^.\n\r]*?{_RUN}[^.\n\r]*?\b(?:is\s+your\s+(?:{_AFTER_ISSUER}|code|verification|verify)|to\s+(?:{_AFTER_ISSUER}|confirm|verify|access|sign[-\s]?in|enroll))\b",
    ),
    ("ios-autofill", r"(?i)<#>\s*\d{3,8}\s+is\s+your\s+code[^\n\r]*@[A-Za-z0-9.\-]+"),
    ("android-sms-retriever", r"(?i)\[#\]\s*\d{3,8}(?:\s+is\s+your\s+(?:verification\s+code|code|OTP))?"),
    ("auth-app-notification", rf"(?i)\b(?:Google\s*Authenticator|Authy|1Password|Duo|Microsoft\s*Authenticator)\b[^\n\r]{{0,60}}?{_RUN}"),
    ("auth-app-dash", r"(?i)\b(?:one[-\s]?time\s+password|passcode|OTP)\b[^\n\r]{0,20}?\b\d{3}[-\s]\d{3}\b"),
    ("keyword-left-digit", rf"(?i)\b{_LEFT_WORDS}\b[^\n\r]{{0,40}}?{_RUN}"),
    ("digit-keyword-right", rf"(?i){_RUN}[^\n\r]{{0,40}}?\b(?:is\s+your|your)?\s*{_RIGHT_WORDS}\b"),
    ("google-g-prefix", r"(?i)\bG-\d{6}\b"),
    ("label-colon-digit", rf"(?i)\b{_LABELS}\s*[:\-]\s*\d{{3,4}}[-\s]?\d{{3,4}}\b"),
    ("use-code-verb", rf"(?i)\b(?:Use\s+code|Use)\s+\d{{3,4}}[-\s]?\d{{3,4}}\s+to\s+(?:verify|confirm|access|sign[-\s]?in|authenticate|recover|enroll|complete)\b"),
    ("digit-issuer-right", rf"(?i){_RUN}\s+is\s+your\s+{_RIGHT_ISSUERS}\b[^\n\r]*?\b(?:code|verification|security|sign[-\s]?in|passcode|OTP|access)\b"),
    ("password-reset-prose", r"(?i)\b(?:click\s+(?:here\s+)?to\s+reset|reset\s+your\s+password|password\s+reset|account\s+recovery|recover\s+account|recover\s+your\s+account)\b[^\n\r]*"),
    ("sentinel-never-share", r"(?i)\b(?:Don't\s+share\s+(?:this|it|with\s+anyone)|Never\s+share|We\s+will\s+never\s+call\s+to\s+ask|do\s+not\s+share)\b[^\n\r]*"),
)


def rule_mark(rule: str) -> str:
    """What takes the place of a match of a rule."""
    return "[REDACTED:BANK_NOTIFICATION]" if rule == "bank-notification" else "[REDACTED:SMS_OTP]"


def masked(text):
    """text with every secret as a marker of its kind."""
    return reduce(lambda t, s: F.regexp_replace(t, s[1], f"[REDACTED:{s[0]}]"), SECRETS, F.coalesce(text, F.lit("")))


def secret_kinds(text):
    """The kinds of secrets in a text, in the order of the table."""
    return F.array_compact(F.array(*[F.when(F.coalesce(text, F.lit("")).rlike(p), F.lit(k)) for k, p in SECRETS]))


def canonical(kind: str, form: str, value):
    """The name under which equal entities meet; a secret has only its form's."""
    if kind == "redacted_token":
        return F.lit(form)
    if form in ("email", "ipv6", "bech32", "uuid"):
        return F.lower(value)
    if form in ("phone", "github_ref"):
        return F.regexp_replace(value, r"[^0-9]", "")
    if form == "ulid":
        return F.upper(value)
    if form == "url":
        site = F.regexp_extract(value, r"^([A-Za-z]+://[^/?#]*)", 1)
        return F.concat(F.lower(site), F.substring(value, F.length(site) + 1, F.length(value)))
    return value


def hinted(form: str, text):
    """Whether a text can hold a shape."""
    hint = HINTS[form]
    return text.rlike(hint) if isinstance(hint, str) else reduce(lambda a, b: a | b, [F.contains(text, F.lit(h)) for h in hint])


def spans(text):
    """Entities of a text as an array of (begin, end, kind, name), in its order; positions count characters from 0.

    Every shape is looked for in the whole text.  Secrets are blanked before any
    other shape is, so an address with a secret in it ends where that begins.
    Of spans that overlap the one that begins first stays, then the shorter,
    then the one listed first.
    """
    text = F.coalesce(text, F.lit(""))
    clean = F.when(F.contains(text, F.lit(_BEGIN)) | F.contains(text, F.lit(_END)), F.translate(text, _BEGIN + _END, "  ")).otherwise(text)
    blank = F.array_join(F.transform(_pieces(clean, "", SECRET), lambda p, i: F.when(i % 2 == 1, F.repeat(F.lit(" "), F.length(p))).otherwise(p)), "")
    held = reduce(lambda a, b: a | b, [hinted(form, clean) for form, _ in SECRETS])
    both = F.array(F.struct(clean.alias("clean"), F.when(held, blank).otherwise(clean).alias("blank"), clean.rlike(_RUN_OF_26).alias("runs")))  # bound to a variable, so that it is worked out once
    return F.element_at(F.transform(both, _resolved), 1)


def _resolved(t):
    secret = {form for form, _ in SECRETS}
    found = F.array_sort(F.concat(*[_found(t["clean"] if e[1] in secret else t["blank"], t["runs"], order, *e) for order, e in enumerate(ENTITIES)]))
    state = F.struct(F.lit(0).alias("reach"), F.array().cast(_SPANS).alias("kept"))
    fits = lambda s, m: m["begin"] >= s["reach"]
    step = lambda s, m: F.struct(F.when(fits(s, m), m["end"]).otherwise(s["reach"]).alias("reach"), F.when(fits(s, m), F.array_append(s["kept"], m)).otherwise(s["kept"]).alias("kept"))
    return F.aggregate(found, state, step, lambda s: F.transform(s["kept"], lambda m: m.dropFields("order")))


_BEGIN, _END = "\x01", "\x02"
_SPANS = "array<struct<begin:int,end:int,order:int,kind:string,name:string>>"


def _pieces(clean, before: str, pattern: str):
    """The text cut at the ends of matches: every second piece is one."""
    return F.split(F.regexp_replace(clean, f"({before})({pattern})", f"$1{_BEGIN}$2{_END}"), f"[{_BEGIN}{_END}]")


def _found(clean, runs, order: int, kind: str, form: str, before: str, pattern: str):
    """Spans of one shape; the pieces' lengths add up to positions."""
    pieces = _pieces(clean, before, pattern)
    state = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast(_SPANS).alias("found"))

    def step(s, piece):
        value = F.regexp_replace(piece, URL_END, "") if form == "url" else piece
        span = F.struct(s["at"].alias("begin"), (s["at"] + F.length(value)).alias("end"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), canonical(kind, form, value).alias("name"))
        good = s["inside"] & (F.length(span["name"]) >= 10) if form == "phone" else s["inside"]
        return F.struct((s["at"] + F.length(piece)).alias("at"), (~s["inside"]).alias("inside"), F.when(good, F.array_append(s["found"], span)).otherwise(s["found"]).alias("found"))

    can = runs if HINTS[form] == _RUN_OF_26 else hinted(form, clean)
    return F.when(can, F.aggregate(pieces, state, step, lambda s: s["found"])).otherwise(F.array().cast(_SPANS))


def mentions(rows: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    """(id, kind, name, n): entities of each text by canonical name, and how often it has them; null texts have none."""
    spread = rows.select(id_, F.explode(spans(F.col(text))).alias("m"))
    return spread.groupBy(id_, F.col("m.kind").alias("kind"), F.col("m.name").alias("name")).agg(F.count("*").alias("n"))


def redacted(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with the text redacted by the ordered rules, and `rules` with the names of those that matched."""
    out, hits = F.coalesce(F.col(text), F.lit("")), []
    for name, pattern in RULES:
        hits.append(F.when(out.rlike(pattern), F.lit(name)))
        out = F.regexp_replace(out, pattern, rule_mark(name))
    return rows.withColumns({"rules": F.array_compact(F.array(*hits)), text: out})


def without_secrets(rows: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(kept, refused): a row with a secret is refused whole."""
    has = F.size(secret_kinds(F.col(text))) > 0
    return rows.where(~has), rows.where(has)


def domain_suffixes(host):
    """A host and every parent domain of it."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def on_domains(rows: DataFrame, domains: DataFrame, host: str = "host", key: str = "id") -> DataFrame:
    """Rows whose host or a parent domain of it is listed; the list is joined, so it may be of any size."""
    spread = rows.select(key, F.explode(domain_suffixes(F.col(host))).alias("domain"))
    return rows.join(spread.join(domains, "domain", "left_semi").select(key).distinct(), key, "left_semi")


def cascade(*steps):
    """The outcome of the first step (condition, outcome) that holds; an unknown condition suppresses."""
    out = F.when(F.lit(False), F.lit(""))
    for condition, outcome in steps:
        out = out.when(condition.isNull(), F.lit("suppress: unknown")).when(condition, F.lit(outcome))
    return out.otherwise(F.lit("allow"))


def chunks(rows: DataFrame, most: int = 1500, id_: str = "id", text: str = "text") -> DataFrame:
    """(id, n, chunk): a text of up to `most` words whole; else its sentences packed greedily up to `most` words.

    Paragraphs end at an empty line, sentences at `.`, `!` or `?` before white
    space.  In a chunk a paragraph's first sentence follows after an empty line,
    any other after a space.  A longer sentence is a chunk of its own.  Null and
    blank texts give none.
    """
    space = f"[{_SPACE}]"
    trimmed = lambda x: F.regexp_replace(x, f"^{space}+|{space}+$", "")
    count = lambda x: F.size(F.filter(F.split(x, f"{space}+"), lambda w: w != ""))
    whole = F.coalesce(F.col(text), F.lit(""))
    paragraphs = F.filter(F.transform(F.split(whole, "\n\n"), trimmed), lambda p: p != "")
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.transform(F.split(p, f"(?<=[.!?]){space}+"), lambda s, i: F.struct(s.alias("s"), count(s).alias("w"), F.when(i == 0, "\n\n").otherwise(" ").alias("sep")))))
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))
    full = lambda a, x: (a["open"] != "") & (a["n"] + x["w"] > most)

    def step(a, x):
        begun = F.struct(F.array_append(a["done"], a["open"]).alias("done"), x["s"].alias("open"), x["w"].alias("n"))
        longer = F.struct(a["done"].alias("done"), F.when(a["open"] == "", x["s"]).otherwise(F.concat(a["open"], x["sep"], x["s"])).alias("open"), (a["n"] + x["w"]).alias("n"))
        return F.when(full(a, x), begun).otherwise(longer)

    packed = F.aggregate(sentences, state, step, lambda a: F.when(a["open"] != "", F.array_append(a["done"], a["open"])).otherwise(a["done"]))
    return rows.select(id_, F.posexplode(F.when(count(whole) == 0, F.array().cast("array<string>")).when(count(whole) <= most, F.array(whole)).otherwise(packed)).alias("n", "chunk"))


def context_header(app, title, url, ts, body):
    """A line that says where a text was seen, before the text; `?` for what isn't known; an empty text stays empty."""
    known = lambda x: F.coalesce(x.cast("string"), F.lit("?"))
    head = F.concat(F.lit("[app="), known(app), F.lit(" | title="), known(title), F.lit(" | url="), known(url), F.lit(" | ts="), known(ts), F.lit("]\n"))
    return F.when(F.coalesce(body, F.lit("")) == "", F.lit("")).otherwise(F.concat(head, body))


def repeated_chrome(rows: DataFrame, group: list[str], frame: str, title: str, text: str = "text", top: int = 8, bottom: int = 4, one_in: int = 2) -> DataFrame:
    """Lines (group, line) at the edge of a window that one in `one_in` frames of a group has, under three titles at least.

    A line has 2 to 40 words and is among the first `top` or the last `bottom`.
    """
    all_lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x) != "")
    n = F.size(all_lines)
    edge = F.concat(F.slice(all_lines, 1, top), F.when(n > top, F.slice(all_lines, F.greatest(n - bottom + 1, F.lit(top + 1)), bottom)).otherwise(F.array().cast("array<string>")))
    spread = rows.select(*group, frame, title, F.explode(F.array_distinct(edge)).alias("line"))
    fit = F.size(F.split(F.trim("line"), r"\s+")).between(2, 40)
    frames = rows.groupBy(*group).agg(F.countDistinct(frame).alias("__frames"))
    seen = spread.where(fit).groupBy(*group, "line").agg(F.countDistinct(frame).alias("__seen"), F.countDistinct(title).alias("__titles"))
    return seen.join(frames, group).where((F.col("__seen") * one_in >= F.col("__frames")) & (F.col("__titles") >= 3)).select(*group, "line")


def picture_verdict(distance):
    """What a frame's difference to the last stored one says: at most 4 bits drop it, 12 or more store it."""
    return F.when(distance <= 4, "drop").when(distance >= 12, "store").otherwise("tie-break")
