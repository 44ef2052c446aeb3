"""The patterns and words by which questions and notes are told apart. Patterns are for lower-case text and
for any engine without look-around; \\b is a boundary of ASCII words."""

from __future__ import annotations

#: Words of a question that are no terms, and words that are verbs.
QUESTION_STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "do", "does", "for", "from", "how", "i", "in", "into", "is", "it", "me", "of", "on", "or", "the", "this", "to", "where", "which", "who", "why", "with")

#: Words of a question that are no evidence of its subject.
EVIDENCE_STOPWORDS = (
    "the", "and", "for", "with", "from", "into", "that", "this", "then", "than", "what", "when", "where", "which", "who", "why", "how", "does", "work", "works", "system", "process", "implementation",
    "deep", "level", "tell", "everything", "about", "please", "explain", "walkthrough", "overview", "codebase", "repository", "repo", "source", "code",
)

#: How overviews of a whole system are asked for: one of these, or the end-to-end walk of the last two together.
OVERVIEW = (
    r"\b(?:how|what)\b.*\b(?:system|codebase|repository|repo|project|app|application|product|everything|whole|architecture)\b.*\b(?:work|works|working|built|structured|organized|organised|do|does|fit together)\b",
    r"\b(?:overview|big picture|high[- ]level|bird'?s[- ]eye|end[- ]to[- ]end)\b.*\b(?:system|codebase|repository|repo|project|app|application|architecture|flow)\b",
    r"\b(?:system|codebase|repository|repo|project|architecture)\b.*\b(?:overview|big picture|high[- ]level|end[- ]to[- ]end)\b",
)
END_TO_END = r"\bend[- ]to[- ]end\b"
WALK = r"\b(?:what happens|how|walk(?: me)? through|flow|overview)\b"

#: Words that ask for the surroundings of the code.
SUPPORTING = r"\b(deep|implementation|algorithm|architecture|actors?|themes?|technology|configuration|config|dependencies|dependency|install|installs|package|packages|package manager|npm|pnpm|yarn|node_modules|typescript|tsconfig|python|pip|venv|virtualenv|requirements|pyproject|poetry|rust|cargo|crate|crates|db|database|datastore|store|storage|orm|model|models|migration|schema|repository|repo|controller|dao|sql|query|queries|lance|lancedb|vector|embedding|embeddings|index|indexing|indexed|search|retrieval|chunk|chunking|stack|librar(?:y|ies)|frameworks?|tooling|setup|built with|powered by|runs on|written in|uses?|using)\b"

VISUAL = r"\b(visual|visually|visualize|picture|pictures|diagram|draw|map)\b"
CHILD = r"\b(5 year old|five year old|child|kid)\b"
#: Requests to tell the same again in another way.
RETELLING = r"\b(explain it|give it|show it|make it simpler|simplify|i don't get it|dont get it)\b"

#: Follow-ups that ask for another style only, unless (for the second) they name a subject.
STYLE_ONLY = r"\b(explain it|make it simpler|simplify|plain english|i don't understand|i dont understand|visual thinker)\b"
STYLE = r"\b(visual|visually|visualize|diagram|flowchart|picture|draw|map|simpler|simplify|high level|plain english)\b"
SUBJECT = r"\b(api|pipeline|llm|ui|text|server|route|database|index|retrieval|component|file|source|function|class|auth|upload)\b"

#: Intents, in the order that decides ties.
INTENTS = ("locate_source", "show_code", "explain_behavior", "explain_role", "simulate_change", "verify_understanding", "compare", "plan_change")

#: Fixed values: (intent, points, pattern) for a question that a pattern matches.
INTENT_PATTERNS = (
    ("locate_source", 3, r"^(which|what)\s+file\b|^where\s+(is|are)\b"),
    ("locate_source", 2, r"\b(file|path|defined|defines|definition|located|live|lives|implemented|implementation|imported|exported)\b"),
    ("locate_source", -2, r"\b(work|works|flow|fit|fits|role|why|how)\b"),
    ("show_code", 5, r"\b(show|see|display|open|include)\b.*\b(code|source|html|css|markup|stylesheet|styles?|file|files)\b|\b(show me the code|show me code|show the code)\b"),
    ("show_code", 3, r"\b(html|css|javascript|typescript|jsx|tsx|react|markup|stylesheet|styles?)\b"),
    ("explain_behavior", 1, r"\b(html|css|javascript|typescript|jsx|tsx|react|markup|stylesheet|styles?)\b"),
    ("show_code", 3, r"\b(index\.html|styles?\.css|\.jsx|\.tsx|\.ts|\.js|\.py|\.go|\.rs|\.java|\.php)\b"),
    ("explain_role", 2, r"\b(relationship|relate|related|connect|connected|how|why|work|works)\b"),
    ("explain_behavior", 1, r"\b(relationship|relate|related|connect|connected|how|why|work|works)\b"),
    ("explain_behavior", 4, r"\b(how|work|works|walkthrough|walk through|flow|process|lifecycle|architecture|explain|trace)\b"),
    ("explain_behavior", 2, r"\b(api|endpoint|route|request|response|stream|sse|auth|login|upload)\b"),
    ("explain_behavior", 7, VISUAL + "|" + CHILD),
    ("explain_role", 5, r"\b(fit|fits|role|part|relationship|relate|related|connect|connected|where.*fit|where.*come in)\b"),
    ("explain_role", 2, r"\b(llm|llms|model|models|planner|tools?|agent|cache|memory|index|retrieval)\b"),
    ("simulate_change", 5, r"\b(what if|simulate|scenario|case|when .* fails|failure|fails|breaks|edge case|alternate|instead)\b"),
    ("verify_understanding", 5, r"\b(quiz|test me|verify|ready|understand|comprehension|check my understanding)\b"),
    ("compare", 5, r"\b(compare|versus|vs\.?|difference|different|same|tradeoff|better|worse)\b"),
    ("plan_change", 4, r"\b(change|modify|add|remove|build|implement|refactor|fix|ship|ask an llm|prompt)\b"),
    ("plan_change", 3, r"\b(without breaking|risk|safe|impact|side effect)\b"),
)
#: Fixed values: (intent, points, words) for a question that has one of the words among its terms.
INTENT_TERMS = (
    ("locate_source", 1, ("file", "path", "function", "class", "module", "component")),
    ("show_code", 2, ("source", "code")),
    ("show_code", 1, ("code", "source", "html", "css", "stylesheet", "markup", "component")),
    ("explain_behavior", 1, ("work", "works", "explain", "stream")),
    ("explain_role", 2, ("fit", "relate", "connect", "role")),
)
#: A term or a pattern that asks for a place, worth two points once.
FIND = "find"
FIND_PATTERN = r"^show me where\b"

#: What tells a question's scope.
FILE_SCOPE = r"\b(file|path|line|function|class|symbol|defined|definition|code|source|html|css|stylesheet|markup)\b"
FEATURE_SCOPE = r"\b(feature|behavior|flow|api|auth|user|product)\b"
SYSTEM_SCOPE = r"\b(system|architecture|service|services|llm|llms|model|models|planner|tools?|retrieval|codebase|repository|repo|whole|overall|big picture|end[- ]to[- ]end)\b"

#: What tells the shapes of an answer.
SHOWS_CODE = r"\b(show|see|display|open|include|give)\b.*\b(code|source|html|css|markup|stylesheet|styles?|file|files)\b|\b(show me the code|show me code|show the code|more code|much more code|code displayed)\b"
SHOWS_FIGURE = r"\b(visual|visually|visualize|picture|pictures|diagram|draw|map|flowchart|flow|lifecycle|sequence)\b"
SEQUENCE = r"\b(sequence|request|response|api|endpoint|route|client|server|browser|frontend|backend|stream|streaming|sse|websocket|event)\b"
UI_ANSWER = r"\b(ui|browser|frontend|screen|button|click|clicked|input|form|render|component)\b"
API_ANSWER = r"\b(apis?|endpoints?|routes?|requests?|responses?|sse|streams?|streaming)\b|\b(client|browser|frontend)\b.*\b(server|backend|handler)\b|\b(server|backend|handler)\b.*\b(client|browser|frontend)\b"
FLOW_ANSWER = r"\b(api|flow|process|stream|sse|lifecycle|relationship|fit|fits|role|visual|visualize|picture|pictures|diagram|draw|map)\b"

#: Fixed values: (domain, pattern, words that a question of the domain is searched with too).
DOMAINS = (
    ("api", r"\b(apis?|endpoints?|routes?|requests?|responses?|sse|streams?|streaming|servers?)\b", "API route endpoint request response stream event handler server controller"),
    ("llm", r"\b(llm|llms|model|models|ai|agent|planner|prompt|prompts|tools?|tool-call|tool calls?)\b", "LLM model AI agent prompt tool call inference completion embedding reranking orchestration"),
    ("memory", r"\b(cache|memory|prior|similar|trace|traces|history|replay|remember)\b", "cache memory prior similar history replay persistence"),
    ("data_storage", r"\b(db|database|datastore|store|storage|orm|model|models|migration|schema|repository|repo|controller|dao|sql|query|queries|vector|embedding|embeddings|index|indexing|indexed|search|retrieval|chunk|chunking)\b", "database datastore storage repository controller ORM model migration schema SQL query vector embedding index indexing chunking retrieval store upsert table search"),
    ("dependencies", r"\b(dependencies|dependency|install|installs|package|packages|package manager|npm|pnpm|yarn|node_modules|typescript|tsconfig|python|pip|venv|virtualenv|requirements|pyproject|poetry|rust|cargo|crate|crates|configuration|config)\b", "dependencies dependency install package manager manifest package metadata repository exports types configuration lockfile registry source features"),
    ("ui", r"\b(ui|browser|frontend|component|components|render|screen|visual|visually|diagram|mermaid|html|css|react)\b", "frontend UI browser component renderer HTML CSS template stylesheet DOM event listener form input"),
    ("source_code", r"\b(code|source|html|css|javascript|typescript|jsx|tsx|markup|stylesheet|styles?|template|show me)\b", "source code language parser symbol definition call import markup stylesheet template selector DOM className"),
    ("visual_explanation", r"\b(visual|visually|visualize|picture|pictures|diagram|draw|map|like a child|5 year old|five year old)\b", "visual explanation mermaid_figure sequenceDiagram flowchart product story behavior flow"),
)

#: Fixed values: (pattern, terms) by which the code graph is searched beyond a question's own terms.
GRAPH_TERMS = (
    (r"\b(ui|html|markup|dom|button|form|input|screen|page|component|css|style|selector|animation|layout|theme)\b", ("markup", "style", "ui", "selector", "css", "html")),
    (r"\b(route|endpoint|api|handler|server|request|response)\b", ("route", "handler", "get", "post", "put", "delete")),
    (r"\b(entrypoint|entry point|main|cli|command|start|startup|boot|server)\b", ("entrypoint", "main", "start", "server")),
    (r"\b(db|database|store|storage|query|schema|model|table|vector|embedding|index)\b", ("storage", "query", "table", "vector", "embedding", "index")),
    (r"\b(config|configuration|env|environment|setting|option)\b", ("configuration", "config", "env")),
    (r"\b(dependency|dependencies|package|install|manifest|npm|pip|cargo|crate)\b", ("dependency", "package", "manifest", "import")),
)

#: Sub-queries of an overview, and of a question about an interface; the last only where failures are asked for.
OVERVIEW_SEEDS = ("application entry point startup initialization", "main orchestration core pipeline flow", "data storage persistence read write", "user-facing output response rendering", "configuration wiring setup")
API_SEEDS = ("API route endpoint registration handler server", "request body query schema validation contract", "response stream SSE JSON event writer", "client fetch API caller usage frontend", "cache persistence save trace story storage")
API_QUESTION = r"\b(api|endpoint|route|request|response|sse|stream|streaming)\b"
FAILURE_SEED = "API error invalid request abort failure response"
FAILURE = r"\b(error|failure|fail|abort|cancel|not ready|invalid|validation)\b"

#: Notes that restate the syntax and teach nothing.
WEAK_NOTES = (
    r"^delegates to the next function or returns the result\.$",
    r"^shows the source statement this explanation is grounded in\.$",
    r"^defines the function or class being explained\.$",
    r"^checks a condition before continuing the operation\.$",
    r"^marks an active source line in this excerpt\.$",
    r"^calls\s+\S+\s+to\b",
    r"\bcarry out the surrounding\b",
    r"^stores\s+\S+\s+for (?:the surrounding|later)\b",
    r"^keeps\s+.{1,80}\s+visible because\b",
    r"^runs inside (?:for|if|while|switch|try|catch|else|return|do)\b",
    r"^runs inside \S+, tying this line to the surrounding\b",
    r"^connects this (?:line|excerpt) to the\b",
    r"^highlights\b",
    r"^highlights syntax:",
    r"\bas part of the storage or retrieval operation\b",
    r"\bas (?:relevant|the available) source evidence\.?$",
    r"^sends incremental output through\b",
)
#: Words that a note must not be built on.
NON_TEACHING = ("for", "if", "while", "switch", "try", "catch", "else", "return", "do", "case", "document", "window", "console", "globalthis", "this")
