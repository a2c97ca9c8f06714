"""The catalogue of line rules: category, rule, flags and pattern, matched JVM-side in one pass over the lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: category|rule|flags|pattern (i ignore case, m lines, s dot takes line ends)
CATALOGUE = r'''
security|sql-concat|i|(execute|executemany|query|raw_sql|session\.execute)\s*\(\s*f?["']
security|sql-f-string|i|(cursor|conn|db|session)\.execute\(\s*f["']
security|sql-interpolated|i|f["'][^"]*(SELECT|INSERT|UPDATE|DELETE|DROP)[^"]*%\{[^}]+\}[^"]*["']
security|eval-exec|i|\b(eval|exec)\s*\(
security|os-system||\bos\.system\s*\(
security|subprocess-shell|i|subprocess\s*\.\s*(call|run|Popen)\s*\([^)]*shell\s*=\s*True
security|shell-true|i|shell\s*=\s*True
security|inner-html|i|(innerHTML|outerHTML|dangerouslySetInnerHTML)\s*=
security|pickle-loads||pickle\s*\.\s*loads?\s*\(
security|yaml-load|i|yaml\s*\.\s*load\s*\((?![^)]*Loader\s*=)[^)]*\)
security|str-format-sql|is|(SELECT|INSERT|UPDATE|DELETE).{0,200}%(s|d)\s*[,)]
security|path-join-user|i|os\.path\.join\s*\(\s*[^,]+,\s*(request|user_input|name|filename|path)
security|subprocess-untrusted|i|subprocess\s*\.\s*(call|run|Popen)\s*\([^)]*
security|deserialize|i|(loads|load)\s*\(\s*(request|data|body|content|input)
security|hardcoded-secret|i|(password|secret|api_key|token)\s*=\s*["'][A-Za-z0-9_\-]{8,}["']
security|crypto-md5||hashlib\s*\.\s*md5\s*\(
security|crypto-sha1||hashlib\s*\.\s*sha1\s*\(
error_handling|bare-except|m|^\s*except\s*:
error_handling|swallowed-except|m|except\s+[^:]+:\s*\n\s*(pass|return\s+None|continue|break)
error_handling|broad-except|m|except\s+(Exception|BaseException|RuntimeError)\s*(as\s+\w+)?\s*:
error_handling|no-timeout-http|i|(requests|httpx|urllib)\.(get|post|put|delete|request)\((?![^)]*timeout=)[^)]*\)
error_handling|resource-open|i|^\s*(?!with\b)(?:[A-Za-z_]\w*\s*=\s*)?\bopen\s*\([^)]*\)(?!\s*as\b)
correctness|off-by-one|m|range\s*\(\s*[^)]*<\s*len\([^)]*\)\s*\)|range\s*\(\s*len\([^)]*\)\s*\+\s*1
correctness|float-equality|m|\b\d+\.\d+\b\s*==\s*[^=]|\b[a-z_]\w*\s*==\s*\d+\.\d+
correctness|assignment-in-condition|m|if\s+[^=!<>]*(?:=|:=)[^=]
correctness|unchecked-index|m|\[[^\]]*\]\s*\n.{0,120}index|items\[[^\]]*\]
correctness|mutable-default|m|def\s+\w+\s*\([^)]*=\s*(\[\]|\{\}|set\(\))\s*[,)]
testing|skipped-test|m|@pytest\.mark\.skip|pytest\.skip\s*\(|unittest\.skip|@unittest\.skip
testing|empty-test|m|def\s+test_\w+\s*\([^)]*\):\s*\n\s*(pass|\.\.\.)
testing|assert-true|m|assert\s+[^=!<>]+\s*==\s*True|assertTrue\s*\(
testing|time-independent|m|assert\s+.{0,60}(time|datetime|now|date)\.
performance|query-in-loop|m|for\s+[^\n]*:\s*\n\s*[^\n]*\b(?:db|session|conn|cursor)\.[^\n]*\b(?:execute|filter|query|find|get)\s*\(
performance|query-in-loop-inline|m|for\s+[^\n]*:\s*[^\n]*\.\b(?:filter|query|find)\s*\(
performance|blocking-in-async|m|async\s+def\s+\w+[^\n]*:\s*\n\s*[^\n]*\b(?:time\.sleep|requests\.|httpx\.|socket\.)\b
performance|blocking-in-async-inline|m|async\s+def\s+\w+[^\n]*:\s*[^\n]*\b(?:time\.sleep|requests\.)\b
performance|lru-cache-unbounded|m|@lru_cache(?!\s*\(\s*maxsize)
performance|len-in-loop-condition|m|while\s+[^\n]*len\([^\n]*\)\s*[<>!=]+
maintainability|todo-fixme|i|\b(?:TODO|FIXME|XXX|HACK)\b
maintainability|module-mutable-global|m|^[A-Z_]{2,}\s*=\s*(\[\]|\{\}|set\(\))
observability|debug-print|m|^\s*(?:\w+\s*=\s*)?print\s*\(
observability|silent-except|m|except\s+[^:]+:\s*\n\s*(pass|continue|return\s+None)
data_integrity|mutate-while-iterate|m|for\s+[^\n]*:\s*\n\s*[^\n]*\b(?:remove|pop|discard)\s*\s*
data_integrity|destructive-alter|i|\bDROP\s+(?:COLUMN|TABLE)\b|ALTER\s+TABLE[^\n]*\bDROP\b
data_integrity|unchecked-json|i|json\s*\.\s*loads?\s*\(\s*(?:request|data|body|content|input)\s*\)
accessibility|img-without-alt|i|<img\b(?![^>]*\balt=)[^>]*>
accessibility|clickable-div|i|<div\b[^>]*\bonclick=
accessibility|input-without-label|i|<input\b(?![^>]*\btype=["']?(?:hidden|submit|button|reset)["']?)(?![^>]*\b(?:aria-label|aria-labelledby)=)[^>]*>
accessibility|onclick-without-keys|i|<(?:div|span)\b[^>]*\bon(?:Click|click)\s*=\s*\{[^}]*\}(?![^>]*\bonKeyDown)
concurrency|check-then-act|m|if\s+[^\n]*\b(?:in|not in)\s+[^\n]+:\s*\n\s*[^\n]*\b(?:remove|pop|discard|add|append)\s*
concurrency|thread-pool-in-loop|m|for\s+[^\n]*:\s*\n\s*[^\n]*ThreadPoolExecutor
concurrency|shared-counter|m|^\s*\w+\s*\+=\s*1\s*$
dependencies|unpinned-requirements|m|^[A-Za-z0-9_.\-]+$
dependencies|broad-version-range||[\w.\-]+\s*>=\s*\d+(?:\.\d+)*
dependencies|npm-wildcard||["'][^"']+["']\s*:\s*["']\*["']
dependencies|npm-latest|i|["'][^"']+["']\s*:\s*["']latest["']
privacy|log-sensitive-field|i|(?:logger|log|logging)\.\w+\([^)]*\b(?:password|passwd|api[_-]?key|secret|token|ssn|credit[_-]?card|email)\b\s*[=:})]
privacy|sensitive-in-exception|i|raise\s+\w+\([^)]*\b(?:password|api[_-]?key|secret|token|ssn)\b
privacy|vars-dump||(?:print|logger\.\w+)\s*\([^)]*\b(?:vars|locals)\s*\(
i18n|hardcoded-date-format||(?:format|formatDate|strftime|dayjs|moment)\([^)]*["'][^"']*(?:YYYY|YY|MM|DD|%Y|%m|%d)[^"']*["']
i18n|unlocalized-jsx-text||>\s*[A-Za-z][A-Za-z ]{8,}\s*<
i18n|hardcoded-attr-string||(?:label|title|placeholder|aria-label|alt)\s*=\s*["'][A-Za-z][^"']{3,}["']
api_contract|added-export|m|^\s*export\s+(?:function|const|class|default|type|interface|\{)
api_contract|added-route|i|@\w*\.(?:get|post|put|delete|patch|route)\s*\(
api_contract|added-signature|m|^\s*(?:def\s+\w+\s*\(|function\s+\w+\s*\(|[\w$.]+\s*=\s*\([^)]*\)\s*=>)
dead_code|import-statement|m|^\s*(?:import|from)\s+\S+
security|ssrf-dynamic-url|i|(requests|httpx|urllib|aiohttp|urlopen)\s*\.\s*(get|post|put|delete|request|urlopen|ClientSession)\s*\([^)]*\b(url|target|endpoint|host|addr|link|callback|next|redirect|uri)\b
security|ssrf-private-target|i|(169\.254\.169\.254|metadata\.google\.internal|100\.100\.100\.200|localhost|127\.0\.0\.1|0\.0\.0\.0|10\.\d{1,3}\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3}|172\.(1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3})
security|path-traversal-open|i|\bopen\s*\(\s*(path|filepath|file_name|filename|target|dest|dst|out|src)\b
security|path-traversal-send|i|(send_file|send_from_directory|FileResponse|StaticFiles)\s*\(
security|path-traversal-shutil|i|shutil\s*\.\s*(copy|move|rmtree|unpack_archive)\s*\([^)]*\b(path|src|src_path|dst|dest|archive|member)\b
authorization|authz-check-present|i|\b(is_owner|owns|has_permission|has_role|require_auth|login_required|permission_required|authorize|check_permission|can_access|current_user|request\.user|verify_token|enforce|user\.id\s*==|owner_id\s*==)\b
authorization|authz-tenant-scope|i|\b(tenant_id|org_id|account_id|team_id|project_id|workspace_id)\b
reliability|retry-loop|im|for\s+\w+\s+in\s+range\s*\(\s*\d+\s*\)\s*:\s*|while\s+[^:]*\b(retry|attempts|tries)\b
reliability|retry-without-backoff|im|(time\.sleep|asyncio\.sleep)\s*\(\s*(0|0\.0)\s*\)|for\s+\w+\s+in\s+range\s*\(\s*[2-9]\d*\s*\)\s*:
reliability|idempotency-evidence|i|\b(idempoten[ct]y|Idempotency-Key|dedup|dedupe|unique_constraint|at_least_once|exactly_once)\b
reliability|non-idempotent-sink||\b(charge|debit|transfer|pay|send_mail|send_email|publish|enqueue|create_order)\s*\(
reliability|ack-after-failure|i|\b(ack|acknowledge|commit|nack|reject)\s*\(
architecture|module-mutable-global|m|^[A-Za-z_]\w*\s*=\s*(dict\s*\(\s*\)|list\s*\(\s*\)|set\s*\(\s*\)|\{\s*\}|\[\s*\])\s*$
architecture|bypass-service-layer|m|^\s*from\s+\S+\.\S*\b(models|entities|schemas)\b\s+import\s+\S*
architecture|business-in-route|im|@\w+\.(get|post|put|delete|patch)\s*\([^)]*\)\s*\n\s*def\s+\w+\s*\([^)]*\)\s*:\s*\n\s*(db|session|repository|service)\s*\.\s*(query|add|delete|update|commit)
compatibility|schema-shape-change|i|\b(schema|avro|protobuf|proto|wire_format|serialize|deserialize|migration|event_type|message_type|version)\b
compatibility|renamed-config|i|\b(renamed|deprecat|migrat|backward|compatib|old_client|breaking)\b
compatibility|flag-flip|i|\b(feature_flag|feature_flags|flags?\[|get_flag|is_enabled|rollout)\b
configuration|env-var-read|i|os\.(environ|getenv)\s*\[?["']([A-Z][A-Z0-9_]{2,})["']
configuration|config-reference||\b(settings|config|Configuration)\.[A-Za-z_]\w*\b
configuration|deployment-manifest|i|(ports\s*:|containerPort\s*:|image\s*:|env\s*:|secrets?\s*:|configMap|healthCheck|readiness|startupProbe)
configuration|env-default-mismatch||getenv\s*\(\s*["'][A-Z][A-Z0-9_]{2,}["']\s*,\s*["'][^"']*["']\s*\)
resource_lifecycle|open-no-with|im|^\s*(?!with\b)(?:[A-Za-z_]\w*\s*=\s*)?\bopen\s*\([^)]*\)(?!\s*as\b)
resource_lifecycle|lock-acquired|i|(\.acquire\s*\(|threading\.Lock\s*\(|asyncio\.Lock\s*\(|RLock\s*\()
resource_lifecycle|timer-registered||\b(setInterval|setTimeout|Timer|schedule\.every|add_periodic_task|loop\.call_later)\s*\(
resource_lifecycle|listener-subscribed||\b(addEventListener|on\(|subscribe|connect|listen|register_handler|signal\.connect)\s*\(
resource_lifecycle|temp-file-created||\b(tempfile\.|TemporaryFile|NamedTemporaryFile|mkstemp|mkdtemp)\b
resource_lifecycle|transaction-started|i|\b(begin\s*\(|start_transaction|session\.begin|\.transaction\s*\()
'''

RULES = [tuple(x.split("|", 3)) for x in CATALOGUE.strip().splitlines()]


def java_pattern(flags: str, pattern: str) -> str:
    """With Unicode classes and Unix line ends, as the patterns are meant."""
    return f"(?dU{flags})" + pattern


def hits(text: Column, rules: list[tuple[str, str, str, str]] = RULES) -> Column:
    """Array of (category, rule) structs of the rules that the text meets."""
    each = [F.when(text.rlike(java_pattern(fl, p)), F.struct(F.lit(c).alias("category"), F.lit(r).alias("rule_id"))) for c, r, fl, p in rules]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def rule_hits(lines: DataFrame, text: str = "text", rules: list[tuple[str, str, str, str]] = RULES) -> DataFrame:
    """One row per line and rule met; lines come with all their columns."""
    return lines.withColumn("_h", F.explode(hits(F.col(text), rules))).select("*", F.col("_h.category").alias("category"), F.col("_h.rule_id").alias("rule_id")).drop("_h")
