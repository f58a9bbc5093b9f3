"""Rule tables that operators take as defaults.

All values here are fixed: names, patterns, numbers and their order decide results.
"""

from __future__ import annotations

#: (provider, pattern of the whole id, group of the zone or region, entity type, group of the name; group 0 of the name is the whole id).
RESOURCE_IDS = [
    ("gcp", r"^projects/([^/]+)/zones/([^/]+)/instances/([^/]+)$", 2, "API_NODE", 3),
    ("gcp", r"^gcp:compute:instance/(.+)$", 0, "API_NODE", 1),
    ("aws", r"^arn:aws:ec2:([^:]+):([^:]+):instance/([^/]+)$", 1, "API_NODE", 3),
    ("aws", r"^aws:ec2:instance/(.+)$", 0, "API_NODE", 1),
    ("aws", r"^i-[0-9a-f]{8,17}$", 0, "API_NODE", 0),
    ("azure", r"^/subscriptions/([^/]+)/resourceGroups/([^/]+)/providers/Microsoft.Compute/virtualMachines/([^/]+)$", 0, "API_NODE", 3),
    ("azure", r"^azure:vm:(.+)$", 0, "API_NODE", 1),
    ("k8s", r"^([a-z0-9-]+)/([a-z0-9-]+)-([a-z0-9]{5})$", 0, "API_NODE", 2),
    ("k8s", r"^k8s:pod:(.*)/(.+)$", 0, "API_NODE", 2),
    ("k8s", r"^k8s:([a-z0-9-]+)$", 0, "API_NODE", 1),
    ("gcp", r"^projects/([^/]+)/instances/([^/]+)$", 0, "DATABASE_NODE", 2),
    ("aws", r"^arn:aws:rds:([^:]+):([^:]+):db:([^/]+)$", 1, "DATABASE_NODE", 3),
    ("aws", r"^aws:rds:db/(.+)$", 0, "DATABASE_NODE", 1),
    ("k8s", r"^service/([a-z0-9-]+)/([a-z0-9-]+)$", 0, "API_NODE", 2),
    ("k8s", r"^k8s:service:(.*)/(.+)$", 0, "API_NODE", 2),
]

ZONES = {
    "us-central1-a": "us-central1", "us-central1-b": "us-central1", "us-central1-c": "us-central1", "us-east1-b": "us-east1", "us-east1-c": "us-east1",
    "us-west1-a": "us-west1", "us-west1-b": "us-west1", "europe-west1-b": "europe-west1", "europe-west1-c": "europe-west1",
    "asia-southeast1-a": "asia-southeast1", "asia-southeast1-b": "asia-southeast1",
}

TAG_DEFAULTS = {"criticality": "LOW", "sla_tier": "Best Effort"}
TAGS_BY_TYPE = {
    "DATABASE_NODE": {"criticality": "HIGH", "sla_tier": "24x7"},
    "API_NODE": {"criticality": "MEDIUM", "sla_tier": "Business Hours"},
}
#: (entity type, pattern found in the name, tags); the first that matches counts.
TAG_RULES = [
    ("DATABASE_NODE", "^(postgres|mysql|mongo)", {"service_name": "data-tier", "owner_team": "platform-db", "environment": "prod"}),
    ("API_NODE", "^(payment|checkout)", {"service_name": "payments", "owner_team": "payments-team", "criticality": "CRITICAL", "sla_tier": "24x7"}),
    ("API_NODE", "^(catalog|product)", {"service_name": "catalog", "owner_team": "catalog-team"}),
    ("API_NODE", "^frontend", {"service_name": "frontend", "owner_team": "web-team"}),
    ("API_NODE", "^(recommendation|checkoutservice|productcatalogservice|frontend)", {"service_name": "shop", "owner_team": "ecommerce-team"}),
    ("API_NODE", ".*", {"service_name": "default-service", "owner_team": "platform-team"}),
]

#: Part of a service name, entity type; the first that is contained counts.
SERVICE_TYPES = [
    ("api", "API_NODE"), ("gateway", "API_NODE"), ("frontend", "API_NODE"), ("proxy", "API_NODE"),
    ("database", "DATABASE_NODE"), ("db", "DATABASE_NODE"), ("postgres", "DATABASE_NODE"), ("mysql", "DATABASE_NODE"), ("redis", "DATABASE_NODE"), ("mongodb", "DATABASE_NODE"),
    ("worker", "WORKER_NODE"), ("background", "WORKER_NODE"), ("queue", "WORKER_NODE"),
    ("cache", "INFRASTRUCTURE"), ("loadbalancer", "INFRASTRUCTURE"), ("dns", "INFRASTRUCTURE"),
]

SAFE_ACTIONS = ("restart_service", "scale_deployment", "clear_cache", "kill_pod", "rollback")
SENSITIVE_ACTIONS = ("block_ip", "rotate_credentials")
#: (entity type, its actions in the order in which they are tried).
ACTIONS = [
    ("API_NODE", ("restart_service", "scale_deployment", "clear_cache", "kill_pod", "rollback", "block_ip")),
    ("DATABASE_NODE", ("restart_service", "rollback", "clear_cache", "rotate_credentials")),
    ("SERVICE", ("restart_service", "scale_deployment", "kill_pod", "rollback")),
    ("K8S_RESOURCE", ("kill_pod", "scale_deployment")),
    ("INFRASTRUCTURE", ("restart_service", "clear_cache")),
]

DRIFT_PATTERNS = ("config_file_changed", "config_drift", "config.*drift", "unauthorized.*config.*change")
DRIFT_FIELDS = ("attack_type", "event_type", "type", "description", "message", "event")
APPROVED_FIELDS = ("change_id", "config_file", "file", "path", "description", "message")

ESCALATION = r"(?i)\b(sudo|su|escalat|role_change)"
ADMINS = ("root", "admin", "sysadmin", "sre", "platform-admin")
#: A metric whose name holds one of these is a security metric.
SECURITY_WORDS = ("auth", "login", "access", "crypto")
AUTH_WORDS = ("auth", "login", "failed")

RELEVANT_REASONS = (
    "memorypressure", "diskpressure", "pidpressure", "nodenotready", "nodeready", "rebooted", "backoff", "crashloopbackoff",
    "killing", "evicted", "evicting", "preempting", "nodememorypressure", "nodediskpressure",
)
RELEVANT_WORDS = ("pressure", "evict", "restart", "crashloop")

#: (metric, kind of limit, limit).
METRIC_RULES = [("latency_p99", "zscore", 3.0), ("error_rate", "above", 0.05), ("request_volume", "below_share", 0.5)]

#: Days that rows of a table are kept.
RETENTION = {"metrics": 90, "logs": 30, "traces": 30, "anomalies": 90, "incidents": 365, "feature_vectors": 90}

#: Words in an event's type that send it to one detector, in this order.
ATTACK_ROUTES = (
    ("CONFIG_DRIFT", ("config_drift", "config_file_changed", "unauthorized_config", "unauthorized.*config")),
    ("BRUTE_FORCE", ("brute_force", "auth_failure", "failed_login", "login_fail")),
    ("PRIVILEGE_ESCALATION", ("privilege_escalation", "priv_escalation", "sudo", "role_change")),
)
#: What an edge of each type says about itself.
EDGE_PROPERTIES = {
    "DEPENDS_ON": ("dependency_type", "criticality"),
    "CALLS": ("latency_p50", "latency_p95", "latency_p99", "error_rate"),
    "READS_FROM": ("query_type", "avg_duration_ms"),
}
#: The framework that a compliance report answers to; others are "General".
FRAMEWORKS = {"Incident Response Evidence": "SOC2/ISO27001", "Security Event Summary": "ISO27001/HIPAA", "SLA Compliance Report": "PCI-DSS"}
