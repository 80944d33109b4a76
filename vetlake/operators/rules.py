"""Rule catalogue: the default rules, selection, presets and custom rules."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import jrx

LAYER_BY_SEVERITY = {"high": "P0", "medium": "P1", "low": "P2"}
SEVERITY_BY_LAYER = {v: k for k, v in LAYER_BY_SEVERITY.items()}
ACTION_BY_SEVERITY = {"high": "block", "medium": "review", "low": "remediate"}
_SPELLINGS = {"高风险": "high", "中风险": "medium", "低风险": "low", "high": "high", "medium": "medium", "low": "low"}

# Limits on user-supplied rules.
MAX_CUSTOM_RULES, MAX_CUSTOM_PATTERNS = 64, 32
MAX_NAME_BYTES, MAX_PATTERN_BYTES, MAX_REASON_BYTES, MAX_PAYLOAD_BYTES = 128, 512, 256, 256 << 10


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    severity: str = ""
    layer: str = ""
    weight: float = 0.0
    dtype: str = "pattern"
    function: str = ""
    patterns: tuple[str, ...] = field(default=())
    threshold_low: float = 0.0
    threshold_high: float = 0.0
    action: str = ""
    reason: str = ""

    def normalized(self) -> "Rule":
        """Fill layer from severity and severity from layer."""
        sev = _SPELLINGS.get(self.severity, self.severity)
        layer = self.layer or LAYER_BY_SEVERITY.get(sev, "")
        return Rule(**{**self.__dict__, "severity": sev or SEVERITY_BY_LAYER.get(layer, ""), "layer": layer})


# Pattern lists of the three pattern-type rules.
DESTRUCTIVE_PATTERNS = (
    r"(?i)rm\s+-rf\s+/", r"(?i)dd\s+if=/dev/zero", r"(?i)nc\s+-e\s+/bin/sh", r"(?i)bash\s+-i\s+>&\s+/dev/tcp",
    r"(?i)stratum\+tcp://|xmrig|mining|ransom", r"(?i)EncryptFile.*ransom",
    r"(?i)(\bc2\b|\bbeacon\b|command\s*and\s*control)", r"(?i)(pastebin|ngrok|torproject|duckdns)",
    r"(?i)(irc://|ws://|wss://).*(bot|agent|control)", r"(?i)eval\(|exec\(|system\(",
)
BACKDOOR_PATTERNS = (
    r"(?i)(backdoor|debug_secret|admin_secret|magic_token)", r"(?i)(debug|admin)_backdoor",
    r"(?i)if.*(token|input|secret|password).*(exec|system|eval|shell)",
    r"(?i)(time\.After|time\.Sleep|setTimeout).*?(exec|system|eval|shell)",
)
SELF_UPDATE_PATTERNS = (
    r"(?i)auto[_-]?update|self[_-]?update|download[_-]?and[_-]?exec", r"(?i)(curl|wget).*?(bash|sh|python|node)",
    r"(?i)http\.(Get|Post).*?(exec|system|eval)",
)

# Id, name, severity, detection function, failure reason.
_CATALOG = [
    ("V7-001", "恶意代码与破坏性行为", "high", "", "检测到恶意代码或破坏性行为"),
    ("V7-002", "后门与条件触发逻辑", "high", "", "检测到后门或条件触发逻辑"),
    ("V7-003", "敏感数据外发与隐蔽通道", "high", "detectDataExfiltration", "检测到敏感数据外发或隐蔽通道"),
    ("V7-004", "硬编码真实凭证", "high", "detectHardcodedCredential", "检测到硬编码真实凭证"),
    ("V7-005", "许可证验证配置缺陷", "high", "evaluateLicenseValidationConfig", "检测到许可证验证失败放行、本地默认授权服务或可绕过配置"),
    ("V7-006", "技能声明与实际行为一致性", "high", "intent", "技能声明与实际行为严重不一致"),
    ("V7-007", "MCP 工具滥用与工具权限过大", "high", "detectMCPAbuse", "检测到 MCP 工具滥用或工具权限过大"),
    ("V7-008", "沙箱逃逸与提权风险", "high", "detectEnvironmentEvasion", "检测到沙箱逃逸、反分析或提权风险"),
    ("V7-009", "自更新与远程下载执行", "high", "", "检测到自更新或远程下载执行逻辑"),
    ("V7-010", "依赖漏洞与恶意依赖", "high", "evaluateDependencyVulns", "检测到高危漏洞、恶意依赖或不可信依赖"),
    ("V7-011", "动态指令注入与可执行上下文拼接", "high", "evaluateInjectionRisk", "检测到未防护的动态指令注入或可执行上下文拼接"),
    ("V7-012", "权限声明与最小权限", "high", "evaluatePermissions", "检测到过度权限声明或最小权限缺失"),
    ("V7-013", "路径遍历与文件越权", "high", "evaluatePathTraversal", "检测到路径遍历或文件越权风险"),
    ("V7-014", "SSRF 与内网探测", "high", "evaluateSSRFProtection", "检测到 SSRF 或内网探测风险"),
    ("V7-015", "工具响应投毒与间接提示注入", "medium", "evaluateToolResponsePoisoning", "检测到工具响应投毒或间接提示注入风险"),
    ("V7-016", "凭据缓存与跨任务隔离", "medium", "evaluateCredentialIsolation", "检测到凭据缓存或跨任务隔离不足"),
    ("V7-017", "敏感上下文与错误信息泄露", "medium", "evaluateContextLeak", "检测到敏感上下文或错误信息泄露"),
    ("V7-018", "外部软依赖完整性", "medium", "evaluateSoftDependencies", "检测到外部软依赖完整性风险"),
    ("V7-019", "不可逆或高影响操作审批", "medium", "evaluateIrreversibleOpsApproval", "检测到不可逆或高影响操作缺少审批"),
    ("V7-020", "输入 Schema", "medium", "evaluateInputSchema", "检测到输入 Schema 或校验不足"),
    ("V7-021", "日志审计与敏感信息脱敏", "medium", "evaluateAuditLogging", "检测到日志审计或敏感信息脱敏不足"),
    ("V7-022", "SBOM、版本锁定与来源可信", "medium", "evaluateSBOMVersionLock", "检测到 SBOM、版本锁定或来源可信不足"),
    ("V7-023", "TLS 证书和传输保护", "medium", "evaluateTLSProtection", "检测到 TLS 证书或传输保护不足"),
    ("V7-024", "文件上传和文件解析安全", "medium", "evaluateFileUploadParsing", "检测到文件上传或文件解析安全风险"),
    ("V7-025", "隐私合规与数据最小化", "medium", "evaluateDataMinimizationEvidence", "检测到隐私合规或数据最小化不足"),
    ("V7-026", "资源耗尽与级联失败", "low", "evaluateResourceRisk", "检测到资源耗尽或级联失败风险"),
    ("V7-027", "记忆与上下文污染", "low", "evaluateMemoryIsolation", "检测到记忆或上下文污染风险"),
    ("V7-028", "不安全反序列化和模型文件加载", "low", "evaluateUnsafeDeserialization", "检测到不安全反序列化或模型文件加载风险"),
    ("V7-029", "隐藏内容、混淆与诱导性描述", "low", "evaluateHiddenContent", "检测到隐藏内容、混淆或诱导性描述"),
    ("V7-030", "调试接口与测试后门残留", "low", "evaluateDebugBackdoor", "检测到调试接口或测试后门残留"),
]
_PATTERNS_BY_ID = {"V7-001": DESTRUCTIVE_PATTERNS, "V7-002": BACKDOOR_PATTERNS, "V7-009": SELF_UPDATE_PATTERNS}


def default_rules() -> list[Rule]:
    out = []
    for rid, name, sev, fn, reason in _CATALOG:
        pats = _PATTERNS_BY_ID.get(rid, ())
        dtype = "pattern" if pats else ("llm_intent" if fn == "intent" else "function")
        out.append(Rule(rid, name, sev, dtype=dtype, function="" if fn == "intent" else fn, patterns=tuple(pats),
                        action=ACTION_BY_SEVERITY[sev], reason=reason).normalized())
    return out


RULES = {r.rule_id: r for r in default_rules()}

RULE_SCHEMA = (
    "rule_id string, name string, severity string, layer string, weight double, "
    "detection struct<type:string,function:string,patterns:array<string>,threshold_low:double,threshold_high:double>, "
    "on_fail struct<action:string,reason:string>, seq int"
)


def rules_df(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    """Rules as a (driver-sized) DataFrame; its length is the length of the rule list."""
    rows = [
        (r.rule_id, r.name, r.severity, r.layer, float(r.weight),
         (r.dtype, r.function, list(r.patterns), float(r.threshold_low), float(r.threshold_high)), (r.action, r.reason), i)
        for i, r in enumerate(rules if rules is not None else default_rules())
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def parse_custom_rules(raw: str) -> list[Rule]:
    """JSON list of user rules -> validated rules; entries without name, severity or pattern are dropped.

    More or longer rules, patterns or names than the limits allow are an error, never dropped.
    """
    if not raw or not raw.strip():
        return []
    if len(raw.encode()) > MAX_PAYLOAD_BYTES:
        raise ValueError(f"custom rules have more than {MAX_PAYLOAD_BYTES} bytes")
    try:
        items = json.loads(raw)
    except ValueError:
        return []
    if not isinstance(items, list):
        return []
    out: list[Rule] = []
    if len(items) > MAX_CUSTOM_RULES:
        raise ValueError(f"more than {MAX_CUSTOM_RULES} custom rules")
    for item in items:
        name = str(item.get("name", "")).strip()
        sev = _SPELLINGS.get(str(item.get("severity", "")).strip().lower(), "")
        sev = sev or SEVERITY_BY_LAYER.get(str(item.get("layer", "")).strip().upper(), "")
        pats = [p.strip() for p in item.get("patterns") or []]
        pats = [p for p in pats if p]
        if not name or not sev or not pats:
            continue
        if len(pats) > MAX_CUSTOM_PATTERNS or any(len(p.encode()) > MAX_PATTERN_BYTES for p in pats) or len(name.encode()) > MAX_NAME_BYTES:
            raise ValueError(f"custom rule {name[:40]!r} exceeds the limits on names and patterns")
        for p in pats:
            jrx(p)  # an error here, not in the middle of a scan
        reason = str(item.get("reason", "")).strip() or "命中自定义规则"
        if len(reason.encode()) > MAX_REASON_BYTES:
            raise ValueError(f"reason of custom rule {name[:40]!r} exceeds {MAX_REASON_BYTES} bytes")
        rid = str(item.get("id", "")).strip() or f"CUSTOM-{len(out) + 1}"
        out.append(Rule(rid, name, sev, patterns=tuple(pats), action=ACTION_BY_SEVERITY[sev], reason=reason).normalized())
    return out


def select_rules(rules: list[Rule], ids: list[str] | None = None, custom: list[Rule] | None = None) -> list[Rule]:
    """Chosen ids (none = all), then the custom rules."""
    chosen = set(ids or [])
    return [r for r in rules if not chosen or r.rule_id in chosen] + list(custom or [])


PRESETS = {
    "default-all": ("high", "medium", "low"),
    "strict-admission": ("high", "medium", "low"),
    "fast-review": ("high", "medium"),
    "high-risk-gate": ("high",),
}


def preset_rules(key: str, rules: list[Rule] | None = None) -> list[Rule]:
    """Named selection by severity."""
    keep = PRESETS[key]
    return [r for r in (rules if rules is not None else default_rules()) if r.severity in keep]
