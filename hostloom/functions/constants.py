"""Rule tables, keyword lists, patterns and weights that results depend on."""

# Column rules by category, pattern on the lower-cased name and confidence, in order.
COLUMN_RULES = {
    "hostname": [(".*hostname.*", 0.95), (".*host_name.*", 0.95), (".*server.*name.*", 0.9), (".*instance.*name.*", 0.9), (".*machine.*name.*", 0.85), (".*device.*name.*", 0.85), (".*node.*name.*", 0.85), (".*computer.*name.*", 0.85), (".*fqdn.*", 0.95), (".*host.*", 0.7), (".*server.*", 0.6), (".*instance.*", 0.6), (".*node.*", 0.6)],
    "ip": [(".*ip.*address.*", 0.95), (".*ip_addr.*", 0.95), (".*ipv4.*", 0.95), (".*ipv6.*", 0.95), (".*private.*ip.*", 0.9), (".*public.*ip.*", 0.9), (".*internal.*ip.*", 0.9), (".*external.*ip.*", 0.9), (".*ip.*", 0.7), (".*address.*", 0.5)],
    "environment": [(".*environment.*", 0.95), (".*env.*", 0.9), (".*stage.*", 0.8), (".*tier.*", 0.7)],
    "application": [(".*application.*", 0.95), (".*app.*name.*", 0.9), (".*service.*name.*", 0.9), (".*app.*", 0.7), (".*service.*", 0.7), (".*component.*", 0.6)],
    "owner": [(".*owner.*", 0.95), (".*team.*", 0.9), (".*department.*", 0.8), (".*contact.*", 0.7), (".*managed.*by.*", 0.8)],
    "location": [(".*region.*", 0.95), (".*zone.*", 0.9), (".*datacenter.*", 0.95), (".*dc.*", 0.7), (".*location.*", 0.8), (".*site.*", 0.7)],
    "cluster": [(".*cluster.*", 0.95), (".*pool.*", 0.7), (".*group.*", 0.6)],
    "project": [(".*project.*", 0.95), (".*gcp.*project.*", 0.95), (".*aws.*account.*", 0.9), (".*azure.*subscription.*", 0.9)],
}
# LIKE patterns of the fast column search.
SEARCHED_COLUMNS = ["hostname", "host_name", "server_name", "servername", "machine_name", "computer_name", "node_name", "instance_name", "fqdn", "host", "hosts", "server", "servers", "node", "nodes"]

# Patterns of single values.
HOSTNAME = r"^[a-z0-9]([a-z0-9\-]{0,61}[a-z0-9])?(\.[a-z0-9]([a-z0-9\-]{0,61}[a-z0-9])?)*$"
LOOSE_HOSTNAME = r"^[a-zA-Z0-9]([a-zA-Z0-9\-\.]*[a-zA-Z0-9])?$"
IPV4 = r"^([0-9]{1,3}\.){3}[0-9]{1,3}$"
IPV6 = r"^([0-9a-fA-F]{0,4}:){7}[0-9a-fA-F]{0,4}$"
NAME_CATALOGUE = {"aws_ec2": r"^ec2-\d{1,3}-\d{1,3}-\d{1,3}-\d{1,3}", "gcp_instance": r"^[a-z][-a-z0-9]{0,62}$", "azure_vm": r"^[a-zA-Z][a-zA-Z0-9-]{1,59}$"}
# Patterns whose shares are features of a column; the first 18, and 25 in all.
VALUE_PATTERNS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "url": r"^https?://[^\s]+$",
    "ipv4": r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$",
    "ipv6": r"^(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$",
    "uuid": r"^[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}$",
    "date_iso": r"^\d{4}-\d{2}-\d{2}",
    "datetime_iso": r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}",
    "phone_us": r"^(\+1)?[\s.-]?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}$",
    "hostname": r"^[a-zA-Z0-9][a-zA-Z0-9-]{0,61}[a-zA-Z0-9]?$",
    "fqdn": r"^[a-zA-Z0-9][a-zA-Z0-9-]{0,61}[a-zA-Z0-9]?(\.[a-zA-Z0-9][a-zA-Z0-9-]{0,61}[a-zA-Z0-9]?)*$",
    "mac_address": r"^([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})$",
    "md5": r"^[a-f0-9]{32}$",
    "sha1": r"^[a-f0-9]{40}$",
    "sha256": r"^[a-f0-9]{64}$",
    "base64": r"^[A-Za-z0-9+/]+=*$",
    "json": r"^\{.*\}$|^\[.*\]$",
    "xml": r"^<.*>.*</.*>$",
    "credit_card": r"^\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}$",
    "ssn": r"^\d{3}-\d{2}-\d{4}$",
    "zip_us": r"^\d{5}(-\d{4})?$",
    "hex_color": r"^#[0-9A-Fa-f]{6}$",
    "aws_arn": r"^arn:aws:[a-z0-9-]+:[a-z0-9-]*:\d{12}:",
    "docker_image": r"^[a-z0-9]+([._-][a-z0-9]+)*(/[a-z0-9]+([._-][a-z0-9]+)*)*",
    "semver": r"^\d+\.\d+\.\d+",
    "jwt": r"^[A-Za-z0-9-_]+\.[A-Za-z0-9-_]+\.[A-Za-z0-9-_]+$",
}
# Substrings of a column's name that are features.
NAME_WORDS = ["id", "name", "email", "phone", "address", "date", "time", "amount", "price", "cost", "value", "count", "number", "host", "server", "ip", "domain", "url", "path", "user", "customer", "client", "owner", "created", "modified"]
MORE_NAME_WORDS = [
    "id", "identifier", "key", "code", "num", "number", "name", "title", "label", "description", "desc", "email", "mail", "address", "addr", "phone", "tel", "mobile", "cell",
    "date", "time", "timestamp", "created", "modified", "updated", "amount", "price", "cost", "value", "balance", "total", "sum", "count", "quantity", "qty",
    "host", "hostname", "server", "machine", "node", "instance", "ip", "ipaddr", "ip_address", "domain", "url", "uri", "path", "endpoint", "user", "username", "customer", "client", "person", "owner",
    "status", "state", "flag", "active", "enabled", "type", "kind", "category", "class", "env", "environment", "region", "zone", "datacenter", "dc", "app", "application", "service", "component",
    "version", "ver", "revision", "build", "error", "exception", "warning", "info", "debug", "config", "configuration", "setting", "param", "parameter",
]
# The rule classifier's types in order, with patterns and weights (case is ignored, a match is at the start).
TYPE_PATTERNS = {
    "hostname": [(r"^[a-zA-Z0-9][a-zA-Z0-9-]{0,61}[a-zA-Z0-9]?$", 0.9), (r"^(server|host|node|machine)", 0.7)],
    "ip_address": [(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$", 0.95), (r"^(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$", 0.95)],
    "email": [(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$", 0.95)],
    "timestamp": [(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", 0.9), (r"^\d{10,13}$", 0.7)],
    "numeric_id": [(r"^\d+$", 0.8)],
    "url": [(r"^https?://[^\s]+$", 0.95)],
    "phone": [(r"^(\+\d{1,3})?[\s.-]?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}$", 0.9)],
}
# Name hints in order; the first that applies raises its type to the floor.
NAME_HINTS = [(("host", "server"), "hostname", 0.7), (("ip",), "ip_address", 0.7), (("email", "mail"), "email", 0.7), (("time", "date"), "timestamp", 0.6), (("id", "key"), "numeric_id", 0.5)]
ENSEMBLE_WEIGHTS = {"sherlock": 0.25, "sato": 0.30, "doduo": 0.35, "llm": 0.10}

# Keywords in a hostname, in order, for discovery.
ENVIRONMENTS = [("production", ["prod", "prd", "live"]), ("staging", ["stage", "stg", "uat"]), ("development", ["dev", "develop"]), ("testing", ["test", "tst", "qa"])]
REGIONS = [("us-east-1", ["use1", "useast", "virginia"]), ("us-west-2", ["usw2", "uswest", "oregon"]), ("eu-west-1", ["euw1", "euwest", "ireland"]), ("asia-southeast-1", ["apse1", "singapore"])]
REGION_OCTETS = [(50, "us-east-1"), (100, "us-west-2"), (150, "eu-west-1")]
HOST_TYPES = [("web_server", ["web", "www", "nginx", "apache"]), ("database", ["db", "database", "mysql", "postgres", "mongo"]), ("api_server", ["api", "rest", "graphql"]), ("cache", ["cache", "redis", "memcache"]), ("message_queue", ["queue", "rabbit", "kafka", "sqs"]), ("load_balancer", ["lb", "load", "balancer", "haproxy"])]
DISCOVERY_WEIGHTS = {"ip_address": 0.2, "environment": 0.2, "application": 0.15, "datacenter": 0.15, "host_type": 0.1}
# The same for enrichment, whose lists differ.
INFERRED_ENVIRONMENTS = [("production", ["prod", "prd", "production"]), ("staging", ["stage", "stg", "staging"]), ("development", ["dev", "develop", "development"]), ("testing", ["test", "tst", "qa", "uat"]), ("sandbox", ["sandbox", "sbx", "demo"])]
INFERRED_REGIONS = [("us-east-1", ["use1", "useast1", "virginia", "iad"]), ("us-west-1", ["usw1", "uswest1", "california", "sjc"]), ("us-west-2", ["usw2", "uswest2", "oregon", "pdx"]), ("eu-west-1", ["euw1", "euwest1", "ireland", "dub"]), ("ap-southeast-1", ["apse1", "singapore", "sin"])]
INFERRED_SYSTEMS = [("windows", ["win", "windows", "ws"]), ("linux", ["linux", "ubuntu", "centos", "rhel"]), ("macos", ["osx", "mac", "darwin"])]
ENRICHMENT_WEIGHTS = {"hostname": 1.0, "environment": 0.8, "datacenter": 0.7, "os_type": 0.6, "owner": 0.5, "application": 0.5}

# Entity types in order: name patterns, keywords, boost.
ENTITY_TYPES = [
    ("physical_server", ["^srv-", "^server-", "^phy-"], ["physical", "bare-metal", "hardware"], 0.2),
    ("virtual_machine", ["^vm-", "^virt-", "^guest-"], ["virtual", "vm", "vmware", "hyperv", "kvm"], 0.2),
    ("container", ["^pod-", "^container-", "^docker-"], ["docker", "kubernetes", "k8s", "container", "pod"], 0.25),
    ("cloud_instance", ["^i-[a-f0-9]{8,}", "^[a-z]+-[a-z0-9]+-[a-z0-9]+"], ["ec2", "instance", "aws", "azure", "gcp"], 0.3),
    ("network_device", ["^sw-", "^switch-", "^router-", "^fw-"], ["switch", "router", "firewall", "gateway", "vpn"], 0.25),
    ("storage_device", ["^nas-", "^san-", "^storage-"], ["storage", "nas", "san", "netapp", "emc"], 0.2),
    ("load_balancer", ["^lb-", "^alb-", "^elb-", "^haproxy-"], ["loadbalancer", "lb", "haproxy", "nginx", "f5"], 0.3),
]
SUB_TYPES = [
    ("web_server", ["apache", "nginx", "iis", "httpd", "web"]),
    ("app_server", ["tomcat", "jboss", "websphere", "app"]),
    ("database_server", ["mysql", "postgres", "oracle", "mssql", "mongodb", "db"]),
    ("cache_server", ["redis", "memcache", "varnish", "cache"]),
    ("message_queue", ["rabbitmq", "kafka", "activemq", "sqs", "queue"]),
    ("monitoring", ["nagios", "zabbix", "prometheus", "grafana", "monitor"]),
    ("ci_cd", ["jenkins", "gitlab", "bamboo", "travis", "circleci"]),
    ("security", ["firewall", "ids", "ips", "waf", "security"]),
]
LAST_SUB_TYPES = [("app_server", ["app", "application"]), ("web_server", ["web", "www"]), ("database_server", ["db", "database"]), ("app_server", ["api"])]
IMPORTANT_ATTRIBUTES = ["ip", "environment", "datacenter", "os", "application", "owner"]
CRITICALITY_ENVIRONMENT = {"production": 40, "disaster_recovery": 35, "staging": 20, "development": 10}
CRITICALITY_APPLICATION = {"database": 30, "api": 30, "load_balancer": 30, "queue": 30, "cache": 30, "web": 20, "mail": 20, "monitoring": 15, "logging": 15}

# Relationship types: description, both directions, strength.
RELATIONSHIP_TYPES = {
    "same_application": ("Part of the same application stack", True, 0.9),
    "load_balances": ("Load balancer distributes traffic to", False, 0.8),
    "load_balanced_by": ("Receives traffic from load balancer", False, 0.8),
    "connects_to": ("Has connection to", False, 0.7),
    "connected_from": ("Receives connections from", False, 0.7),
    "same_datacenter": ("Located in same datacenter", True, 0.6),
    "same_network": ("On the same network segment", True, 0.7),
    "same_environment": ("In the same environment tier", True, 0.5),
    "parent_of": ("Parent entity of", False, 0.8),
    "child_of": ("Child entity of", False, 0.8),
    "same_cluster": ("Part of the same cluster", True, 0.9),
    "same_owner": ("Managed by same team/owner", True, 0.5),
    "shares_attribute": ("Shares common attribute", True, 0.4),
    "depends_on": ("Has dependency on", False, 0.8),
    "replicated_from": ("Is replica of", False, 0.7),
    "backs_up": ("Provides backup for", False, 0.6),
    "monitors": ("Monitors the health of", False, 0.5),
    "monitored_by": ("Health monitored by", False, 0.5),
}
# Relationships between applications.
APPLICATION_PATTERNS = [("web", "database", "connects_to"), ("api", "database", "connects_to"), ("app", "database", "connects_to"), ("web", "cache", "connects_to"), ("api", "cache", "connects_to"), ("app", "cache", "connects_to"), ("web", "queue", "connects_to"), ("api", "queue", "connects_to"), ("app", "queue", "connects_to"), ("load_balancer", "web", "load_balances"), ("load_balancer", "api", "load_balances"), ("load_balancer", "app", "load_balances"), ("monitoring", "web", "monitors"), ("monitoring", "database", "monitors"), ("monitoring", "api", "monitors"), ("backup", "database", "backs_up"), ("backup", "storage", "backs_up")]
# Fields of quality analysis, vocabulary, words that don't belong in production.
REQUIRED_FIELDS = ["hostname", "environment", "datacenter", "application", "owner", "os_type"]
TEST_WORDS = ["test", "temp", "demo", "sample"]
# Declared limits of anomaly detection.
NAMING_CONVENTIONS = [r"^[a-z0-9\-\.]+$", r"^[A-Z0-9\-\.]+$"]
PRIVATE_RANGES = [(r"^10\.", "Private Class A"), (r"^172\.(1[6-9]|2[0-9]|3[0-1])\.", "Private Class B"), (r"^192\.168\.", "Private Class C")]
RESOURCE_LIMITS = {"cpu_cores": (1, 128), "memory_gb": (1, 1024), "disk_gb": (10, 100000)}
AGE_LIMITS = (0, 1095)
# Texts of insights and recommendations.
INSIGHTS = {
    "low_ratio": "Low non-production to production ratio (%.1f:1) - Consider if testing resources are adequate",
    "high_ratio": "High non-production to production ratio (%.1f:1) - Opportunity for resource optimization",
    "missing": "Missing standard environments: %s",
    "no_application": "%d entities with unknown application - Improve application tagging",
    "one_place": "All infrastructure in single datacenter - Consider multi-region for resilience",
    "many_places": "Infrastructure spread across %d datacenters - Review if consolidation is possible",
    "systems": "Managing %d different OS types - Consider standardization",
    "physical": "High number of physical servers - Consider virtualization or containerization",
    "containers": "Container-heavy infrastructure - Ensure orchestration platform is robust",
    "no_links": "No relationships discovered - Review discovery configuration",
    "few_links": "Very low relationship density - Many isolated components",
    "many_links": "Very high relationship density - Complex interdependencies",
    "clustering": "Strong application clustering detected - Good architectural separation",
    "costly": "%d non-production systems with high resources - Potential cost savings",
    "inactive": "%d inactive systems - Review for decommissioning",
    "public": "%d entities with public IPs - Verify security controls",
    "no_owner": "%d entities without clear ownership - Security and accountability risk",
    "cpu": "Total CPU capacity: %d cores across %d systems (avg: %.1f)",
    "cpu_variance": "Large variance in CPU allocation - Consider load balancing",
    "memory": "Total memory capacity: %,d GB across %d systems",
    "one_application": "'%s' represents %.1f%% of infrastructure - Single point of failure risk",
}
RECOMMENDATIONS = {
    "completeness": "Enrich data sources to improve completeness",
    "consistency": "Standardize naming conventions and data formats",
    "uniqueness": "Implement deduplication process",
    "validity": "Add data validation rules to discovery process",
    "timeliness": "Schedule regular discovery runs to keep data current",
    "relationships": "Review relationship mapping rules",
}
