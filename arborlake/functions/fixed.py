"""Word lists, limits, formats and prices that results depend on, in natural order."""

# --- Fixed values: intent phrases, tested in this order; the last group are prefixes. ---
INTENT_PHRASES = {
    "summarize": ["summarize", "summary", "what is this about", "what does this", "what is this file", "overview", "explain this", "tell me about", "describe this"],
    "entity": ["who is", "who are", "person", "author", "name of", "mentioned", "company", "organization"],
    "comparison": ["compare", "difference", "differ", " vs ", "versus", "better than"],
    "list_extract": ["list all", "list the", "what are the", "enumerate", "features", "all the"],
}
FACTUAL_PREFIXES = ["what", "how", "when", "where", "why", "define", "is there"]
INTENT_BASE = {"summarize": 3, "comparison": 4, "list_extract": 3, "entity": 2, "factual": 2, "specific": 2}
MIN_TOOL_CALLS = {"summarize": 3, "entity": 2, "comparison": 4, "list_extract": 3, "factual": 2, "specific": 2}
INTENT_HINTS = {
    "summarize": "QUERY TYPE: Summarization — expand the top 3-5 most important sections to read their full content before answering.",
    "entity": "QUERY TYPE: Entity lookup — use search_content to find names, people, companies, or organizations. Then expand matching nodes to get full context.",
    "factual": "QUERY TYPE: Factual question — search for the specific topic first, then expand relevant sections to extract the answer.",
    "comparison": "QUERY TYPE: Comparison — identify the items being compared, expand their respective sections, and present differences side by side.",
    "list_extract": "QUERY TYPE: List extraction — find and expand the section(s) that contain the items to list. Read their full content.",
    "specific": "QUERY TYPE: Specific question — search for relevant keywords, then expand matching sections.",
}

# --- Fixed values: words that are no search terms. ---
QUERY_STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might can shall to of in for on with at by from as into "
    "about between through during before after above below and or but not no nor so if than that this it its what which who whom how when where why all "
    "each every both few more most some any me my we our you your he him his she her they them their i tell explain describe summarize summary please "
    "file document mentioned list give show find get"
).split()

# --- Fixed values: words that are no topics. ---
TOPIC_STOP_WORDS = (
    "the a an and or but in on at to for of with by from is are was were be been being have has had do does did will would could should may might shall "
    "can this that these those it its they them their we our you your he she his her not no if than then so as also which what when where who how all "
    "each every both few more most other some such only into over after before between about through during above below up down out off very just now "
    "here there new used using one two three four five first second third"
).split()

# --- Fixed values: lines that are headings by themselves. ---
SECTION_KEYWORDS = [
    "abstract", "introduction", "background", "methodology", "methods", "results", "discussion", "conclusion", "conclusions", "references",
    "bibliography", "acknowledgements", "acknowledgments", "appendix", "literature review", "related work", "future work",
    "education", "experience", "work experience", "professional experience", "skills", "technical skills", "projects", "certifications", "certificates",
    "achievements", "awards", "publications", "languages", "interests", "hobbies", "objective", "summary", "profile", "contact", "contact information",
    "personal information", "personal details", "qualifications",
    "overview", "scope", "definitions", "terms and conditions", "responsibilities", "requirements", "deliverables", "timeline", "budget", "risk assessment",
    "recommendations", "executive summary",
    "table of contents", "glossary", "index", "preface", "foreword",
]

# --- Fixed values: months, and words that start no name. ---
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
NAME_SKIP_WORDS = (
    "The This That These Those When Where What Which How There Here After Before During While Since Until Because Although However Therefore "
    "Furthermore Moreover Additionally Finally Section Chapter"
).split()

# --- Fixed values: what steps are shown as. ---
STEP_LABELS = {"tree_overview": "Reading structure", "search": "Searching content", "expand": "Reading section", "scan_lists": "Scanning lists & tables", "llm_call": "Generating answer"}

# --- Fixed values: limits. ---
CONTENT_BUDGET = 40_000
SECTIONS_PER_DOC = 24
MATCHES_PER_TERM = 12
LISTS_PER_DOC = 12
TERMS_PER_QUERY = 4
GATHER_BYTES = 2000
HISTORY_TOKENS = 8000
RELATIONS_IN_PROMPT = 15
ROWS_PER_FILE = 500
LINES_PER_BLOCK = 60

# --- Fixed values: dollars for a million tokens in and out, by model. ---
PRICES = {
    "claude-sonnet-4-6": (3.0, 15.0), "claude-sonnet-4-5-20250514": (3.0, 15.0), "claude-3-5-sonnet-20241022": (3.0, 15.0), "claude-3-7-sonnet-20250219": (3.0, 15.0),
    "claude-opus-4-6": (15.0, 75.0), "claude-3-opus-20240229": (15.0, 75.0), "claude-haiku-4-5-20251001": (0.80, 4.0), "claude-3-5-haiku-20241022": (0.80, 4.0),
    "claude-3-haiku-20240307": (0.25, 1.25),
    "gpt-4o": (2.50, 10.0), "gpt-4o-mini": (0.15, 0.60), "gpt-4.1": (2.0, 8.0), "gpt-4.1-mini": (0.40, 1.60), "gpt-4.1-nano": (0.10, 0.40),
    "o1": (15.0, 60.0), "o1-mini": (1.10, 4.40), "o3": (10.0, 40.0), "o3-mini": (1.10, 4.40), "o4-mini": (1.10, 4.40),
    "deepseek-chat": (0.27, 1.10), "deepseek-reasoner": (0.55, 2.19), "grok-3": (3.0, 15.0), "grok-3-mini": (0.30, 0.50),
    "qwen-max": (1.60, 6.40), "qwen-plus": (0.40, 1.20), "qwen-turbo": (0.10, 0.30),
    "gemini-2.5-pro": (1.25, 10.0), "gemini-2.5-flash": (0.15, 0.60), "gemini-2.0-flash": (0.10, 0.40), "gemini-1.5-pro": (1.25, 5.0), "gemini-1.5-flash": (0.075, 0.30),
    "llama-3.3-70b-versatile": (0.59, 0.79), "llama-3.1-8b-instant": (0.05, 0.08), "llama-3.2-90b-vision-preview": (0.90, 0.90), "mixtral-8x7b-32768": (0.24, 0.24),
    "gemma2-9b-it": (0.20, 0.20), "mistral-large-latest": (2.0, 6.0), "mistral-small-latest": (0.20, 0.60),
}
DEFAULT_PRICE = (0.50, 1.50)
