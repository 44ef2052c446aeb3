"""Patterns of lines, by language: what a line tells of the code graph."""

from __future__ import annotations

#: For each language the kinds of facts that a line can hold, with a pattern whose first group is the name.
LINE_FACTS: dict[str, dict[str, str]] = {
    "bash": {"configuration": r"^\s*export\s+([A-Z_]+)=", "process": r"\b(exec|nohup|trap)\b", "safety": r"^\s*set\s+(-[euox]+)", "definition": r"^\s*(?:function\s+)?([A-Za-z_]\w*)\s*\(\)"},
    "c": {"entrypoint": r"\bint\s+(main)\s*\(", "io": r"\b(fopen|fread|fwrite|printf|read|write)\s*\(", "memory": r"\b(malloc|calloc|realloc|free)\s*\(", "import": r"^\s*#include\s+[<\"]([^>\"]+)"},
    "cpp": {"entrypoint": r"\bint\s+(main)\s*\(", "io": r"\bstd::(cout|cin|ifstream|ofstream)\b", "memory": r"\b(new|delete|unique_ptr|shared_ptr)\b", "import": r"^\s*#include\s+[<\"]([^>\"]+)", "definition": r"^\s*(?:class|struct)\s+(\w+)"},
    "c-sharp": {"component": r"^\s*public\s+(?:partial\s+)?class\s+(\w+)", "configuration": r"\bConfiguration\[\"([^\"]+)", "entrypoint": r"\bstatic\s+\w+\s+(Main)\s*\(", "route": r"\[(?:Route|Http\w+)\(\"([^\"]*)", "storage": r"\b(DbContext|DbSet)\b", "import": r"^\s*using\s+([\w.]+);"},
    "css": {"design_token": r"(--[\w-]+)\s*:", "style": r"^\s*(@[\w-]+)", "style_property": r"^\s*([a-z-]+)\s*:", "style_rule": r"^\s*([.#]?[\w-]+[^{};]*)\{"},
    "elixir": {"concurrency": r"\b(GenServer|Task|Agent|spawn)\b", "configuration": r"^\s*config\s+:(\w+)", "definition": r"^\s*def(?:p|module)?\s+([\w.?!]+)", "route": r"^\s*(?:get|post|put|delete)\s+\"([^\"]+)", "storage": r"\b(Repo|Ecto)\b"},
    "go": {"cancellation": r"\b(context\.With\w+)", "concurrency": r"\b(go\s+func|chan|sync\.\w+)", "configuration": r"\bos\.Getenv\(\"([^\"]+)", "entrypoint": r"^func\s+(main)\(", "response": r"\bw\.(Write|WriteHeader)\(", "route": r"\.Handle(?:Func)?\(\"([^\"]+)", "storage": r"\b(sql\.Open|gorm)\b", "definition": r"^func\s+(?:\([^)]*\)\s*)?(\w+)\(", "import": r"^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$"},
    "html": {"form_action": r"<form[^>]*action=\"([^\"]+)", "import": r"<(?:script|link|img|a)\b[^>]*?(?:src|href)=\"([^\"]+)", "interaction": r"<(button|input|select|textarea)\b", "markup": r"<(h[1-6]|main|nav|section|article|table|ul)\b"},
    "java": {"component": r"@(Component|Service|Repository|Controller)\b", "configuration": r"@(Value|Configuration)\b", "entrypoint": r"\bstatic\s+void\s+(main)\s*\(", "route": r"@(?:Request|Get|Post|Put|Delete)Mapping\(\"?([^\")]*)", "storage": r"\b(EntityManager|JdbcTemplate|@Entity)\b", "definition": r"\b(?:class|interface|enum)\s+(\w+)", "import": r"^\s*import\s+(?:static\s+)?([\w.]+)"},
    "javascript": {"configuration": r"\bprocess\.env\.(\w+)", "entrypoint": r"\b(listen|createServer)\s*\(", "route": r"\b(?:app|router)\.(?:get|post|put|delete|use)\(\s*['\"]([^'\"]+)", "storage": r"\b(readFile|writeFile|localStorage|createStore)\b", "definition": r"\b(?:function|class)\s+(\w+)", "import": r"(?:from\s+|require\(\s*|import\s+)['\"]([^'\"]+)"},
    "json": {"configuration": r"^\s*\"([^\"]+)\"\s*:"}, "toml": {"configuration": r"^\s*([\w.-]+)\s*="}, "yaml": {"configuration": r"^\s*([\w.-]+)\s*:"},
    "kotlin": {"concurrency": r"\b(launch|async|suspend)\b", "configuration": r"\bgetenv\(\"([^\"]+)", "entrypoint": r"\bfun\s+(main)\s*\(", "route": r"\b(?:get|post|route)\(\"([^\"]+)", "storage": r"\b(Room|Database|Dao)\b", "definition": r"\b(?:fun|class|object)\s+(\w+)", "import": r"^\s*import\s+([\w.]+)"},
    "lua": {"configuration": r"\bos\.getenv\(\"([^\"]+)", "definition": r"\bfunction\s+([\w.:]+)", "module": r"\brequire\s*\(?['\"]([^'\"]+)"},
    "objc": {"memory": r"\b(retain|release|autorelease|strong|weak)\b", "notification": r"\b(NSNotificationCenter)\b", "platform_log": r"\b(NSLog)\b"},
    "ocaml": {"definition": r"^\s*let\s+(?:rec\s+)?(\w+)"}, "rescript": {"definition": r"^\s*(?:let|type|module)\s+(?:rec\s+)?(\w+)"}, "systemrdl": {"definition": r"^\s*(?:addrmap|regfile|reg|field)\s+(\w+)"},
    "php": {"configuration": r"\b(?:getenv|config)\(['\"]([^'\"]+)", "route": r"Route::\w+\(['\"]([^'\"]+)", "storage": r"\b(PDO|DB::\w+|Eloquent)\b", "definition": r"\b(?:function|class)\s+(\w+)", "import": r"^\s*use\s+([\w\\]+)"},
    "python": {"background_task": r"\b(asyncio\.create_task|Thread|celery)\b", "configuration": r"\bos\.(?:environ(?:\.get)?|getenv)[\[(]['\"]([^'\"]+)", "entrypoint": r"__name__\s*==\s*['\"](__main__)", "route": r"@\w+\.(?:route|get|post|put|delete)\(['\"]([^'\"]+)", "schema": r"\bclass\s+(\w+)\(.*(?:BaseModel|Schema|TypedDict)", "storage": r"\b(open|sqlite3|sqlalchemy|Session)\b\(?", "definition": r"^\s*(?:async\s+)?(?:def|class)\s+(\w+)", "import": r"^\s*(?:from|import)\s+([\w.]+)"},
    "rust": {"concurrency": r"\b(spawn|Mutex|Arc|mpsc)\b", "configuration": r"\benv::var\(\"([^\"]+)", "entrypoint": r"\bfn\s+(main)\s*\(", "error_boundary": r"\b(Result<|unwrap_or|anyhow)", "import": r"^\s*(?:pub\s+)?use\s+([\w:]+)", "route": r"#\[(?:get|post|put|delete)\(\"([^\"]+)", "serialization": r"derive\([^)]*(Serialize|Deserialize)", "storage": r"\b(sqlx|diesel|File::open)\b", "definition": r"^\s*(?:pub\s+)?(?:fn|struct|enum|trait)\s+(\w+)"},
    "scala": {"configuration": r"\bConfigFactory\.(\w+)", "entrypoint": r"\bdef\s+(main)\b|\bextends\s+(App)\b", "route": r"\bpath\(\"([^\"]+)", "storage": r"\b(slick|doobie|TableQuery)\b", "definition": r"\b(?:def|class|object|trait)\s+(\w+)", "import": r"^\s*import\s+([\w.]+)"},
    "solidity": {"event": r"^\s*event\s+(\w+)", "event_emit": r"\bemit\s+(\w+)", "guard": r"\b(require|modifier|revert)\b", "storage": r"^\s*mapping\s*\(.*\)\s*(?:public|private|internal)?\s*(\w+)"},
    "tlaplus": {"action": r"^(\w+)\s*==\s*/\\", "invariant": r"^(\w*Inv\w*)\s*=="},
    "zig": {"entrypoint": r"\bfn\s+(main)\s*\(", "error_boundary": r"\b(catch|try|errdefer)\b", "memory": r"\b(allocator|alloc|free)\b"},
}
LINE_FACTS["typescript"] = LINE_FACTS["javascript"]
LINE_FACTS["tsx"] = {"configuration": LINE_FACTS["javascript"]["configuration"], "interaction": r"\b(on[A-Z]\w+)=", "jsx_element": r"<([A-Z]\w*)", "route": r"<Route[^>]*path=\"([^\"]+)", "storage": r"\b(useState|localStorage)\b", "import": LINE_FACTS["javascript"]["import"]}
LINE_FACTS["elisp"] = {"definition": r"^\(def(?:un|var|macro)\s+([\w-]+)"}
