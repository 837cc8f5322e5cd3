"""Word lists, sets and patterns that results depend on, stated as they are."""

# Words that search tokens leave out.
SEARCH_STOP = """a about after again against all also am an and any are as at be because been before being between both
but by can could did do does doing down during each few for from further had has have having he her here hers herself
him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or
other our ours ourselves out over own same she should so some such than that the their theirs them themselves then
there these they this those through to too under until up very was we were what when where which while who whom why
will with would you your yours yourself yourselves""".split()

# Words that source terms leave out.
SOURCE_STOP = """about after again against article could from have into more question research source that their there
these they this those through using what when where which with would your""".split()

# Words that voice tokens leave out.
VOICE_STOP = """the and that this with from have were was are for into about what when where which who why how not but its
their they them then than there here your you our out all can could would should article investigative
investigation""".split()

# Words that workflow terms leave out.
WORKFLOW_STOP = """about after against also and are article author because been before being between could does from have
into investigation more must that the their then there these they this those through was were what when where which while
with would""".split()

# Words that identity words leave out.
IDENTITY_STOP = """a about after again all also an and are as at be because been before between but by can could did do
does for from had has have he her here his how i if in into is it its more most not of on one or our part said she so
some than that the their them then there these they this through to two up usaid cia was we were what when where which
while who why will with would you""".split()

# Words that token coverage leaves out.
COVERAGE_STOP = "the a an and or to of in for with was were is are that this its it".split()

# Link texts that are no anchors.
JUNK_ANCHORS = ["share", "share this post", "read full story", "subscribe", "subscription", "comments", "comment", "restack", "sign in", "sign up", "manage subscription", "download app", "open in app"]

# Terms too generic to search for by themselves.
GENERIC_TERMS = "safety security government state public system systems network networks technology technologies data information report reports article articles program programs".split()

# Words that are no concepts by themselves (besides the generic ones).
CONCEPT_JUNK = """people money brings bring thing things look looking question questions example examples use used using
works work today years way ways new old part case cases story stories article section point points patent camera cameras
surveillance company companies""".split()

# Words that no concept of several words has.
CONCEPT_HARD_JUNK = "people money brings bring thing things discussion example examples".split()

# Infrastructure vocabulary, a signal by co-occurrence only.
INFRASTRUCTURE_TERMS = """tracking location locations vehicle vehicles plate plates license reader readers alpr police law
enforcement database databases analytics integration integrated networked jurisdiction jurisdictions sightings movement
movements roads roadside infrared sensor sensors searchable intelligence""".split()

# Phrases at the end of a preview, and the compound rules' labels.
PREVIEW_PHRASES = ["subscribe to continue reading", "this post is for paid subscribers", "this post is for subscribers", "continue reading this post for free in the substack app"]
PREVIEW_PURCHASE = "purchase a paid subscription after continue-reading boundary"
PREVIEW_UPGRADE = "upgrade to paid continuation boundary"

# Replacement priority of a captured body.
ACCESS_PRIORITY = {"FULL_AUTHOR_EXPORT": 500, "FULL_PUBLIC": 300, "PARTIAL_PREVIEW": 200, "TITLE_ONLY": 100, "FETCH_FAILED": 0}
LOCAL_COPY_PRIORITY = 400

# Query keys that track a reader (besides utm_*).
TRACKING_KEYS = ["fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "igshid", "ref_src"]

# Domains of learned candidates.
LEARNING = {
    "category": "RESEARCH_DISCOVERY CONNECTION_ADDED PERSONNEL_RABBIT_HOLE STRUCTURE REVEAL_ORDER VOICE CAVEAT_REMOVAL CAVEAT_ADDITION SOURCE_TREATMENT STRONGER_INFERENCE WEAKER_INFERENCE FRAMING_CHANGE SERIES_CALLBACK COMPRESSION EXPANSION EXPLANATION CONCLUSION FACTUAL_CORRECTION SEO FORMATTING".split(),
    "scope": ["global", "investigative", "series", "article-specific"],
    "confidence": ["high", "medium", "low"],
    "status": ["pending", "approved", "rejected", "promoted"],
}

# The caution pattern.
CAUTION = (
    r"(?i)\b(?:i (?:can't|cannot|won't|will not|am not going to)|we should be careful|it would be irresponsible|the most defensible"
    r"|what (?:the )?(?:document|page|record|evidence) proves|the (?:available )?evidence (?:allows|supports|does not allow)"
    r"|(?:the )?records? (?:do not|don't) (?:prove|establish|show)|(?:does|do) not (?:prove|establish|show|permit)"
    r"|important distinction|that (?:limit|distinction) matters|to be precise)\b"
)

# Phrases that explain in place of telling, and phrases that perform caution.
REVIEW_STEMS = [
    "that matters", "this matters", "seen in that context", "in other words", "the pattern", "taken together", "the better conclusion", "the harder question", "the answer cannot", "this gives us",
    "that distinction", "the directive", "at minimum", "this does not prove", "the record does not show", "there is no evidence that", "this matters because",
]
CAUTION_STEMS = [
    "i can't prove", "i cannot prove", "i am not going to", "i won't", "the most defensible", "what the document proves", "what the page proves", "what the record proves", "the evidence allows",
    "the evidence supports", "it would be irresponsible", "we should be careful", "important distinction", "that distinction matters", "the file needs a warning label", "to be precise",
]

# Patterns of style: contrasts, what makes a block concrete, first person, emphasis, lists, images and what an image shouldn't claim.
STYLE = {
    "contrast": r"\b(?:not (?:merely|just|only)?\b[^.!?;]{0,90}\bbut\b|both\b[^.!?;]{0,90}\band\b|it would be (?:an equal )?mistake\b)",
    "concrete": r"(?i)\b(?:memo|letter|report|document|record|email|interview|court|contract|investigator|witness|officer|agent|director|president|professor|banker|said|told|wrote|found|arrived|met|paid|hired|sent|visited|19\d\d|20\d\d)\b",
    "first person": r"\b(?:I|me|my|we|our|us)\b",
    "bold": r"(?s)(?<!\*)\*\*(?!\*)(.+?)(?<!\*)\*\*(?!\*)",
    "bold italic": r"(?s)\*\*\*(.+?)\*\*\*",
    "italic": r"(?s)(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)",
    "all bold": r"(?s)\A\s*\*\*[^*].*?\*\*\s*\z",
    "list item": r"(?m)^\s*(?:[-+*]|\d+[.)])\s+\S",
    "list group": r"(?m)(?:^\s*(?:[-+*]|\d+[.)])\s+.+\n?){2,}",
    "image": r"\[IMAGE:\s*([^|\]\n]+)\|\s*ALT:\s*([^\]\n]+)\]",
    "argument": r"(?i)\b(?:proof|proves|exposes|shows that .* secretly)\b",
    "generated": r"(?i)\b(?:ai[- ]generated|generated art)\b",
    "documentary": r"(?i)\b(?:document|memo|record|file|excerpt|clipping)\b",
}
STYLE_OPENINGS = ["this", "that", "the", "it"]

# Triggers, boundaries and redirects of block sequences, and the terms of an auditor.
TRIGGER = r"(?i)\b(?:theor(?:y|ies)|testimon|account|alleg|claim|plot|network|mechanism|overlap|connection|provocative|supplied books?)\b"
BOUNDARY = (
    r"(?i)\b(?:not enough|does not have|do not have|no (?:recovered|authenticated|financial|contemporaneous|direct)|missing (?:bridge|link|record)"
    r"|fails?|unsupported|cannot (?:prove|establish)|contested|never repaired)\b"
)
REDIRECT = (
    r"(?i)\b(?:something else survives|more important|what we can actually prove|cover-up we can .*prove|safer conclusion"
    r"|instead,? the (?:real|documented)|the real discovery)\b"
)
AUDIT = r"(?i)\b(?:prove|proven|evidence|authenticated|unsupported|decisive bridge|payment trail|operational record|maximum thesis|conclusion)\b"
THESIS_FAILS = r"(?i)\b(?:maximum|central|original) thesis fails?\b"
CALLBACK_DENIED = r"(?i)\b(?:not a continuation|callback .* not a claim|not evidence of|analogy only)\b"

# Patterns of the traits of a paragraph, in order.
TRAITS = (
    (r"\?", "fact creates an investigative question"),
    (r"(^|[^A-Za-z0-9_])(I|my|we)($|[^A-Za-z0-9_])", "investigator visibly present"),
    (r"(?i)(^|[^A-Za-z0-9_])(document|memo|file|record|report|email|contract|testified|told)($|[^A-Za-z0-9_])", "documentary receipt drives the prose"),
    (r"(?i)(^|[^A-Za-z0-9_])(but|except|then|now|weird|interesting)($|[^A-Za-z0-9_])", "blunt turn or reveal"),
)
RHYTHM, PLAIN_TRAIT = "natural multi-sentence paragraph rhythm", "concrete explanatory prose"

# What an anchor is taken from where no entity is in its context, in order: acronyms, names, identifiers.
ANCHORS = [
    r"\b[A-Z]{2,}[A-Z0-9.-]*\b",
    r"\b(?:[A-Z][A-Za-z0-9&.'-]+\s+){1,4}[A-Z][A-Za-z0-9&.'-]+\b",
    r"\b[A-Z]{1,4}\d{2,}[A-Z0-9.-]*\b",
]

# The mark before a page of a scanned text.
PAGE_MARK = "\n===== PDF PAGE %d =====\n%s\n"

# The date line of an article.
DATE_LINE = r"(?i)^(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\s+\d{1,2},\s+20\d{2}$"

# Sentences that state nothing, and the patterns of assertion types.
FRAMING = ["that is why the exact wording matters.", "that is a question, not a verdict.", "if this document trail is useful, share it with someone who reads past the headline."]
ASSERTIONS = {
    "final slide": r"^final slide\s*[—-]\s*",
    "action": r"\b(?:asked|called|recommended|directed|reported|assigned|included|warned|described|cost|funded|approved|established)\b",
    "quoted": "[“”\"']",
    "spoken": r"\b(called|said|described|wrote|phrase|quotation)\b",
    "currency": "[$£€]",
    "synthesis first": r"\b(?:documents support|do not support collapsing|are pieces of one administrative design|source trail is)\b",
    "imperative": r"^(?:if .+? (?:share|send)|open|read|save|share|send|comment|examine|subscribe|follow|support|help|bring|invite|look for|test those)\b",
    "factual follow": r"\bfollow\s+(?:four|three|two|\d+)\s+(?:decisions|documents|records)\b",
    "proposition": r"\b(?:is|are|was|were|has|have|had|became|takes shape)\b",
    "number": r"[$£€]|\b\d+(?:\.\d+)?\s*(?:million|billion|countries|police)\b",
    "chronology": r"\b(before|after|then|later|by \w+ \d{4}|across \d{4}|sequence|first|next)\b",
    "year": r"\b(?:19|20)\d{2}\b",
    "causal": r"\b(because|therefore|result|led to|became|produced|built|takes shape)\b",
    "comparative": r"\b(more|less|than|compared|contrast|different|same)\b",
    "relationship": r"\b(interagency|relationship|connection|between|inside|alongside|coordinate)\b",
    "synthesis": r"\b(suggests|implies|most likely|takeaway|conclusion|architecture|design|boundary|tension|distinction|documents|records|assignment|responsibility|paper trail|purpose|payoff|sequence)\b",
}

# Scores from which a claim is strong, supports, or supports in part; the words of a count of four.
SUPPORT = {"strong": 0.46, "supports": 0.62, "partly": 0.38, "four": r"(?i)\bfour (?:decisions|documents|records)\b"}

# Files of an article's project: what is delivered, the papers that lead to it, and the sections of its search package.
PROJECT = {
    "deliverables": ["research_dossier.md", "outline.md", "seo.md", "article.md", "sources.csv", "audit.md"],
    "papers": [
        "research/SOURCE_THESIS.md", "research/STYLE_PROFILE.md", "research/ENTITY_NETWORK.md", "research/RABBIT_HOLE_QUEUE.md", "research/CONNECTION_REPORT.md", "research/CONNECTION_CHAINS.md", "research/BOOK_LEADS.md",
        "research/BIBLIOGRAPHY_TRACE.csv", "research/STORY_DECISION.md", "research/STORY_SPINE.md", "research/WRITER_PACKET.md", "research/SEMANTIC_EDITORIAL_REVIEW.md", "research/QUALITY_GATES.md", "output/editorial_audit.md",
    ],
    "search fields": [
        "Reader-Facing Title", "Reader-Facing Description / Sizzle", "Meta Title", "Meta Description", "URL Slug", "Primary Keyword", "Secondary Keywords", "Social Share Title", "Social Share Description",
        "Hero/Banner Image Concept", "Hero Image Alt Text",
    ],
}

# What a hook of each family must have.
HOOKS = {
    "MONEY": r"[$£€]|\b(?:budget|funding|funds|cost|financial|allocation|line item)\b",
    "TIMELINE date": r"(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+(?:19|20)\d{2}\b",
    "TIMELINE step": r"\b(?:first|then|next|later)\b",
    "DOCUMENT": r"(?i)\b(?:memorandum|memo|report|record|directive|document)\b",
    "CONTRADICTION": r"(?i)\b(?:yet|but|although|while|however|so why|tension)\b",
    "CONNECTION": r"(?i)\b(?:between|with|and|interagency|relationship|connection|coordinate)\b",
    "FOLLOW_THE_PAPER_TRAIL": r"(?i)\b(?:memorandum|report|directive|record)\b",
    "ORDINARY": r"\b(?:but|yet|adds|complicates)\b",
}

# Thresholds of the gate between an article and a query.
GATE = {
    "cooccurrence": 0.50, "concept": 0.35, "infra": 0.50, "semantic with concepts": 0.12, "seed, related": 0.75, "shared, related": 3,
    "semantic with free": 0.16, "concept with free": 0.18, "seed, precedent": 0.50, "semantic alone": 0.34, "shared, precedent": 2, "semantic with seed": 0.10,
}

# Weights of concept hits by their words (three, two, an infrastructure term, any other), and of their co-occurrence.
CONCEPT_WEIGHTS = {"three": 1.9, "two": 1.55, "infrastructure": 1.0, "other": 0.75}
COOCCURRENCE = {"each": 0.34, "phrase": 0.25}

# Weights of the six identity signals.
IDENTITY_WEIGHTS = {"title": 0.25, "headings": 0.10, "principal_entities": 0.20, "topic_keywords": 0.20, "source_families": 0.10, "substantial_text_overlap": 0.15}

# Bounds in seconds of a spoken text, by bucket.
DURATIONS = {"SHORT": (15, 25), "MEDIUM": (30, 60), "LONGSHORT": (60, 120)}

# BM25 constants.
BM25_K1, BM25_B = 1.5, 0.75
