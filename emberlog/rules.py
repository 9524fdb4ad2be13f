"""Fixed values of the analytics: patterns, word lists and weights, each in the order in which it is tried."""

# --- Fixed values: message normalisation, (pattern, replacement), applied one after the other ---
NORMALISATION = [
    (r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<UUID>"),
    (r"(?:Account|account)\s+\d{5,}", "Account <ID>"),
    (r"(?:Card|card)\s+\d{5,}", "Card <ID>"),
    (r"(?:case|Case)\s+\d{5,}", "case <ID>"),
    (r"(?:request|Request|RequestId)\s+\d{5,}", "Request <ID>"),
    (r"(?:transaction|Transaction|TxId)\s+\d{5,}", "Transaction <ID>"),
    (r"(?:order|Order|OrderId)\s+\d{5,}", "Order <ID>"),
    (r"(?:document|Document|DocId)\s+\d{5,}", "Document <ID>"),
    (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "<IP>"),
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<TS>"),
    (r"0x[0-9a-fA-F]+", "<HEX>"),
    (r":(\d{4,5})\b", ":<PORT>"),
    (r"@[0-9a-f]{6,}", "@<ADDR>"),
    (r"/\d+/", "/<NUM>/"),
    (r"\b\d{5,}\b", "<ID>"),
    (r"(?:id|Id|ID)[=:\s]+\d+", "id=<ID>"),
    (r"\?\S+", "?<PARAMS>"),
]
#: Texts of which a message has one if the pattern at the same place fits it; none: it may fit any.
NORMALISATION_NEEDS = [
    ["-"], ["ccount"], ["ard"], ["ase"], ["equest"], ["ransaction", "TxId"], ["rder"], ["ocument", "DocId"], ["."], ["-"], ["0x"], [":"], ["@"], ["/"], [], ["id", "Id", "ID"], ["?"],
]
ERROR_TYPE_PATTERNS = [r"(\w+Exception)", r"(\w+Error)", r"(\w+Failure)", r"(\w+Fault)"]
#: (substrings that the message has all of, or the lower-cased message if marked, error type)
ERROR_TYPE_SUBSTRINGS = [
    (["404"], False, "NotFoundError"), (["500"], False, "ServerError"), (["503"], False, "ServerError"), (["401"], False, "UnauthorizedError"), (["403"], False, "ForbiddenError"),
    (["timeout"], True, "TimeoutError"), (["connection", "refused"], True, "ConnectionError"), (["connection", "failed"], True, "ConnectionError"),
]
#: (substrings of the lower-cased message, all of which it has; "^" marks its start, error type)
DOMAIN_TYPES = [
    (["primeissuerservicessoap", "loadbridgexmlrequest"], "PrimeIssuerSoapProcessingError"),
    (["primeissuerservicessoap", "processing errors"], "PrimeIssuerSoapProcessingError"),
    (["called operation has failed", "processing errors"], "OperationProcessingError"),
    (["step processing failed", "stepcontext"], "CaseStepProcessingFailed"),
    (["non recoverable problem occurred", "manually fixed"], "CaseManualFixRequired"),
    (["asynchronous case processing not started", "synchronous processing has failed"], "CaseSyncStartFailed"),
    (["could not be updated", "account"], "AccountUpdateFailed"),
    (["service exception while processing account data change"], "ServiceExceptionProcessingChange"),
    (["client (customer)", "could not be created"], "CustomerCreateFailed"),
    (["client", "could not be created as account owner"], "AccountOwnerCreateFailed"),
    (["there is not any active tariff of the client"], "ClientTariffMissingError"),
    (["mismatch between token scopes", "operation not allowed"], "TokenScopeMismatchError"),
    (["the header", "x-kb-orig-system-identity", "is empty"], "MissingOrigSystemIdentityHeader"),
    (["queued event", "was not processed"], "QueuedEventNotProcessed"),
    (["^speed-", "#cardsserviceimpl#"], "CardsServiceCallError"),
    (["^speed-", "#cardproductservice"], "CardProductServiceCallError"),
    (["getting subject", "failed"], "GetSubjectsFailed"),
    (["getting card offer for user", "failed"], "GetCardOfferFailed"),
    (["unexpected error occurred during case step processing"], "CaseStepUnexpectedError"),
    (["an unexpected error occurred during step processing, case"], "CaseStepUnexpectedError"),
    (["unexpected exception occurred invoking async method", "asyncstepprocessingexecutorlistenerimpl"], "AsyncStepProcessingError"),
    (["step processing error, context stepcontext"], "CaseStepProcessingError"),
    (["processing of step", "has failed. step is skippable false"], "CaseStepSkippableFalseFailed"),
]
HTTP_TYPES = [(404, "NotFoundError"), (500, "ServerError"), (503, "ServerError"), (401, "UnauthorizedError"), (403, "ForbiddenError")]

# --- Fixed values: taxonomy, (priority, category, subcategory, patterns); higher priorities first, equal ones as listed ---
TAXONOMY = [
    (100, "memory", "out_of_memory", ["OutOfMemory", "OOM", "heap space", "GC overhead"]),
    (90, "memory", "memory_leak", ["memory leak", "MemoryLeak"]),
    (100, "database", "connection", ["database.*connection", "DB.*connection", "JDBC.*connection", "PostgreSQL.*connection"]),
    (95, "database", "deadlock", ["deadlock"]),
    (80, "database", "constraint_violation", ["constraint violation", "unique constraint", "foreign key"]),
    (70, "database", "query_error", ["SQL.*error", "query.*failed", "syntax error.*SQL"]),
    (100, "network", "connection_refused", ["connection refused", "ECONNREFUSED"]),
    (95, "network", "connection_reset", ["connection reset", "ECONNRESET"]),
    (90, "network", "dns", ["DNS.*failed", "UnknownHostException", "ENOTFOUND"]),
    (85, "network", "ssl", ["SSL.*error", "TLS.*error", "certificate", "CERT_"]),
    (100, "timeout", "read_timeout", ["read timeout", "ReadTimeout", "socket timeout"]),
    (95, "timeout", "connect_timeout", ["connect timeout", "ConnectTimeout", "connection timed out"]),
    (90, "timeout", "request_timeout", ["request timeout", "RequestTimeout", "ETIMEDOUT"]),
    (50, "timeout", "generic", ["timeout", "timed out"]),
    (100, "auth", "unauthorized", ["401", "unauthorized", "authentication failed"]),
    (95, "auth", "forbidden", ["403", "forbidden", "access denied", "permission denied"]),
    (90, "auth", "token_expired", ["token expired", "TokenExpired", "JWT expired"]),
    (88, "auth", "token_scope_mismatch", ["TokenScopeMismatchError", "mismatch between token scopes", "operation not allowed"]),
    (100, "business", "not_found", ["404", "not found", "NotFoundException", "does not exist"]),
    (90, "business", "validation", ["validation.*failed", "invalid.*parameter", "IllegalArgument"]),
    (89, "business", "issuer_simple_rejected", ["SimpleError", "Synchronous case processing ended prematurely", r"FlowResult\(status=REJECTED", "Processing of case .* rejected"]),
    (88, "business", "issuer_server_flow", ["ServerError", "Account .* could not be updated", "Service exception while processing account data change"]),
    (80, "business", "business_exception", ["BusinessException", "ServiceBusinessException"]),
    (85, "business", "issuer_processing", [
        "PrimeIssuerSoapProcessingError", "OperationProcessingError", "CaseSyncStartFailed", "AccountUpdateFailed", "CaseStepProcessingFailed", "CaseStepProcessingError",
        "CaseStepUnexpectedError", "CaseStepSkippableFalseFailed", "CaseManualFixRequired", "ServiceExceptionProcessingChange", "CardsServiceCallError", "CardProductServiceCallError",
        "GetCardOfferFailed", "GetSubjectsFailed", "QueuedEventNotProcessed", "AccountOwnerCreateFailed", "CustomerCreateFailed", "ClientTariffMissingError",
    ]),
    (100, "external", "api_error", ["external.*API", "third.*party", "upstream.*error"]),
    (95, "external", "service_unavailable", ["503", "service unavailable"]),
    (80, "external", "server_error", ["500", "internal server error"]),
    (78, "business", "constraint_violation", ["ConstraintViolationException", "ConstraintViolation", "DataIntegrityViolation"]),
    (77, "business", "json_deserialization", ["MismatchedInputException", "JsonParseException", "JsonMappingException", "InvalidTypeId"]),
    (76, "business", "not_found", ["NotFoundException", "ResourceNotFoundException", "EntityNotFoundException"]),
    (75, "business", "illegal_state", ["IllegalStateException", "IllegalArgumentException"]),
    (74, "external", "upstream_error", ["RestClientException", "HttpClientErrorException", "HttpServerErrorException"]),
    (73, "external", "gateway_error", ["502", "504", "bad gateway", "gateway timeout"]),
]

# --- Fixed values: scoring ---
SCORE_WEIGHTS = {"spike": 25, "burst": 20, "new": 15, "regression": 35, "cascade": 20, "cross_ns": 15}
SEVERITY_STEPS = [(80, "critical"), (60, "high"), (40, "medium"), (20, "low")]

# --- Fixed values: environments of namespaces in lower case, (pattern, environment) ---
ENVIRONMENTS = [
    (r"-prod-|\.prod\.|_prod_|^prod-|-prod$", "prod"), (r"-uat-|\.uat\.|_uat_|^uat-|-uat$", "uat"), (r"-sit-|\.sit\.|_sit_|^sit-|-sit$", "sit"), (r"-dev-|\.dev\.|_dev_|^dev-|-dev$", "dev"),
    (r"-test-|\.test\.|_test_|^test-|-test$", "test"), (r"-staging-|\.staging\.|_staging_", "staging"),
]
SEMVER = r"^(\d+)\.(\d+)\.(\d+)(?:-[\w.]+)?(?:\+[\w.]+)?$"

# --- Fixed values: flows and error classes of problem keys (two dialects) ---
FLOWS = [
    ("card-servicing", "card_servicing"), ("card-opening", "card_opening"), ("card-validation", "card_validation"), ("card-sensitive", "card_servicing"), ("click2pay", "click2pay"),
    ("billing", "billing"), ("document-signing", "document_signing"), ("batch-processor", "batch_processing"), ("event-processor", "event_processing"), ("rainbow-status", "client_status"),
    ("client-segment", "client_segment"), ("design-lifecycle", "design_lifecycle"), ("georisk", "georisk"), ("atm-locator", "atm_locator"), ("notification", "notifications"),
    ("pilot-context", "pilot_context"), ("token", "token_service"), ("payment", "payments"), ("auth", "authentication"), ("user", "user_management"), ("report", "reporting"),
    ("batch", "batch_processing"), ("api-gateway", "api_gateway"), ("queue", "messaging"), ("kafka", "messaging"), ("rabbit", "messaging"), ("redis", "caching"), ("cache", "caching"),
    ("postgres", "database"), ("mysql", "database"), ("mongo", "database"),
]
FLOW_SKIP = ["bff", "bl", "feapi", "pcb", "pca", "ch", "v1", "v2", "v3", "v4", "v5"]
REGISTRY_FLOWS = [
    ("card-servicing", "card_servicing"), ("card-opening", "card_opening"), ("card-validation", "card_validation"), ("click2pay", "click2pay"), ("billing", "billing"),
    ("document-signing", "document_signing"), ("batch-processor", "batch_processing"), ("event-processor", "event_processing"), ("rainbow-status", "client_status"),
    ("codelist", "codelist"), ("client-segment", "client_segment"), ("design-lifecycle", "design_lifecycle"), ("georisk", "georisk"),
]
REGISTRY_FLOW_SKIP = ["bff", "bl", "feapi", "pcb", "pca", "ch", "v1", "v2", "v3"]
REGISTRY_CLASSES = [
    ("ServiceBusinessException", "business_exception"), ("ValidationException", "validation_error"), ("ConstraintViolationException", "constraint_violation"), ("AccessDeniedException", "access_denied"),
    ("AuthenticationException", "authentication_error"), ("TimeoutException", "timeout"), ("ConnectionException", "connection_error"), ("SQLException", "database_error"), ("OutOfMemoryError", "memory_error"),
    ("NullPointerException", "null_pointer"), ("IllegalArgumentException", "invalid_argument"), ("IOException", "io_error"), ("ResourceNotFoundException", "not_found"), ("not found", "not_found"),
    ("404", "not_found"), ("401", "unauthorized"), ("403", "forbidden"), ("500", "internal_error"), ("502|503|504", "gateway_error"),
]
UNINFORMATIVE_TYPES = ["unknownerror", "unknown", "error", "exception", "runtimeexception", ""]
#: (substrings of the lower-cased type, any of which it has, class)
TYPE_CLASSES = [
    (["connection", "connect"], "connection_error"), (["timeout"], "timeout_error"), (["validation", "invalid"], "validation_error"), (["auth", "unauthorized", "forbidden"], "auth_error"),
    (["null", "npe"], "null_pointer"), (["outofmemory", "oom"], "memory_error"), (["sql", "database", "db"], "database_error"),
]
MESSAGE_CLASSES = [
    (["connection refused", "connection reset"], "connection_error"), (["timeout", "timed out"], "timeout_error"), (["validation", "invalid"], "validation_error"),
    (["unauthorized", "401"], "auth_error"), (["not found", "404"], "not_found"), (["500", "internal server"], "server_error"),
]

# --- Fixed values: how informative a message is ---
WRAPPER_HANDLED = r"^\w+(?:Exception|Error)\s+error\s+handled\.?$"
WRAPPER_CASE = r"(?:an unexpected error occurred during (?:case )?step processing|asynchronous case processing not started|unexpected exception occurred invoking async method|step processing (?:error|failed),?\s*context\s*stepcontext|processing of step .* has failed)"
SIGNAL_GOOD = [
    "called service", "processing errors", "loadbridgexmlrequest", "not permitted", "access denied|forbidden|unauthorized", "timeout|connection|refused", "sql|database|constraint", "resource not found",
    "token scopes|operation not allowed", "is not filled|not all required data|required field",
    "validation error|validation failed|invalid value|missing field|missing required|must not be null|cannot be null|nesmí mít hodnotu null|nesmí být prázdná",
    "null pointer|npe|nullpointerexception", "jsonparseexception", "invalid user id",
]
SIGNAL_BAD = [
    "step processing failed, context stepcontext", "asynchronous case processing not started", "an unexpected error occurred", "processing of step .* has failed", "handle fault",
    r"error handled\.?$", r"exception error handled\.?$",
]
STRUCTURED_CODE = r"^(SPEED-\d+|ITO-\d+)#([^#]*)#([^#]*)#([^#]*)#([^#]*)#([^#]*)#([^#]*)#([^#]*)#?(.*)$"
STRUCTURED_STATUS = r"^(?:SPEED-\d+|ITO-\d+)#[^#]*#[^#]*#[^#]*#[^#]*#[^#]*#[^#]*#(\d{3})(?:#|$)"
TRACE_NORMALISATION = [
    (r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<UUID>"),
    (r"\b[0-9a-fA-F]{24,64}\b", "<ID>"),
    (r"\b(?:id|ID|Id)[=:]\s*\d+\b", "id=<N>"),
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<TS>"),
    (r"\b1[0-9]{9,12}\b", "<TS>"),
]
STACK_FRAME = r"\s+at\s+[a-z][\w$.]+\.\w+\("
HANDLE_FAULT = r"(?i)Handle fault\. Error:.*?message=([^,\]]+)"
FQCN_PREFIX = r"^(?:[a-zA-Z_]\w*\.)+[A-Z]\w*(?:Exception|Error|Failure|Fault)\s*:\s*"
BARE_PREFIX = r"^[A-Z]\w*(?:Exception|Error|Failure|Fault)\s*:\s*"
GENERIC_CLASSES = [
    "servicebusinessexception", "constraintviolationexception", "unknownerror", "notfounderror", "not_found", "forbiddenerror", "servererror", "unauthorizederror", "accessdeniedexception",
    "mismatchedinputexception", "illegalargumentexception", "internal_error",
]

# --- Fixed values: messages of alerts ---
ALERT_BAD = ["step processing failed, context stepcontext", "asynchronous case processing not started", "an unexpected error occurred", "processing of step", "handle fault"]
ALERT_GOOD = ["called service", "processing errors", "loadbridgexmlrequest", "not permitted", "resource not found", "token scopes", "operation not allowed", "timeout", "connection", "sql"]
CAUSE_STOP_WORDS = ["called", "case", "code", "description", "during", "error", "failed", "failure", "operation", "processing", "service", "step", "unexpected"]
STEP_STOP_WORDS = ["error", "occurred", "during"]
QUALITY_BAD = ["error handled", "service exception", "an error occurred", "unknownerror", "handle fault"]
QUALITY_GOOD = ["card with id", "constraintviolationexception", "jsonparseexception", "accessdeniedexception", "operation not allowed", "scope", "status", "code=", "detail=", "#post#", "#get#"]

# --- Fixed values: keyword guesses of a category, (words of which the lower-cased text has one, category) ---
GUESSES = [
    (["hikaripool", "connection pool", "no available connection"], "database"), (["deadlock", "lock wait timeout", "could not serialize"], "database"),
    (["database", "sql", "jdbc", "postgres", "constraint violation"], "database"), (["timeout", "timed out", "read timed", "connect timed"], "timeout"),
    (["connection refused", "connection reset", "econnrefused", "econnreset"], "network"), (["network", "dns", "broken pipe", "socket"], "network"),
    (["401", "403", "unauthorized", "forbidden", "auth", "token expired"], "auth"), (["not found", "does not exist", "404", "validation", "invalid"], "business"),
    (["illegalargument", "constraint", "missing"], "business"), (["outofmemory", "oom", "heap", "gc overhead"], "memory"),
    (["external", "503", "502", "upstream", "service unavailable", "429", "rate limit"], "external"),
]
#: (category, words, subcategory); a category without a fitting row is "general", auth without one "unauthorized"
SUBGUESSES = [
    ("database", ["pool", "hikari"], "connection_pool"), ("database", ["deadlock"], "deadlock"), ("database", ["constraint", "duplicate"], "constraint"),
    ("timeout", ["read"], "read"), ("timeout", ["connect"], "connect"), ("network", ["refused"], "connection_refused"), ("network", ["reset"], "connection_reset"),
    ("auth", ["token", "expired"], "token_expired"), ("auth", ["403", "forbidden"], "forbidden"), ("external", ["429", "rate"], "rate_limit"), ("external", ["503", "unavailable"], "unavailable"),
    ("business", ["not found", "does not exist"], "not_found"), ("business", ["validation", "invalid"], "validation"),
]

# --- Fixed values: test traffic, severity by scope ---
TEST_ORIGINATORS = ["mochaxtestapp"]
TEST_MIN_SHARE = 0.5
SCOPE_SEVERITY = {"SYSTEMIC": "critical", "CROSS_NS": "high"}
BOOSTED_CATEGORIES = ["database", "auth", "security", "infrastructure"]
NON_PROD = ["-dev", "-fat"]

# --- Fixed values: refinement of unknown categories, (words of which the lower-cased texts have one, category, subcategory) ---
REFINEMENTS = [
    (["configuration error", "config error", "configurationexception", "invalid configuration", "missing configuration", "bad configuration", "property not found", "propertynotfoundexception", "missingpropertyexception"], "config", "configuration_error"),
    (["constraintviolationexception", "constraint violation", "data integrity", "dataintegrityviolationexception", "duplicate key", "unique constraint", "foreign key constraint", "referential integrity"], "database", "constraint_violation"),
    (["accessdeniedexception", "access denied", "permission denied", "insufficientpermission", "securityexception", "authorizationexception", "forbidden access", "not authorized"], "auth", "access_denied"),
    (["invalidformatexception", "invalid format", "jsonparseexception", "jsonmappingexception", "unmarshalexception", "serializationexception", "deserializationexception", "malformed json", "malformed xml"], "serialization", "format_error"),
    (["servicebusinessexception", "businessexception", "business error", "serviceexception", "applicationexception", "domainexception", "business logic", "business rule violated"], "business", "business_exception"),
    (["nullpointerexception", "npe", "null pointer", "is null", "cannot be null", "must not be null", "required field is null", "illegalaargumentexception: null", "emptyresultdataaccessexception"], "code", "null_error"),
    (["illegalstateexception", "illegal state", "invalid state", "inconsistent state", "state machine", "statemachineexception"], "code", "state_error"),
    (["token", "jwt", "oauth", "unauthorized", "forbidden", "authentication", "credential", "password", "login", "session expired", "401", "403"], "auth", "authentication_error"),
    (["timeout", "timed out", "deadline exceeded", "read timed out", "connection timed out", "socket timeout", "request timeout"], "timeout", "timeout_error"),
    (["sql", "database", "db connection", "jdbc", "postgres", "mysql", "mongo", "redis", "connection pool", "pool exhausted", "query failed", "deadlock", "lock wait"], "database", "database_error"),
    (["connection refused", "connection reset", "network unreachable", "host not found", "dns", "socket", "econnreset", "econnrefused", "no route to host", "connection closed", "broken pipe"], "network", "connection_error"),
    (["out of memory", "oom", "heap space", "gc overhead", "memory limit", "outofmemoryerror", "memory allocation", "stack overflow"], "memory", "memory_error"),
    (["external service", "third party", "api error", "upstream", "downstream", "http 5", "bad gateway", "502", "503", "504"], "external", "external_service_error"),
    (["validation", "invalid", "not found", "missing", "required field", "constraint", "business rule", "insufficient", "limit exceeded", "400", "404", "422"], "business", "validation_error"),
    (["kafka", "rabbit", "amqp", "message queue", "consumer", "producer", "offset", "partition", "rebalance", "commit failed"], "external", "messaging_error"),
    (["ssl", "tls", "certificate", "handshake", "x509", "pkix"], "network", "ssl_error"),
    (["json", "xml", "parse", "serialize", "deserialize", "unmarshal", "marshal", "encoding", "decoding"], "serialization", "serialization_error"),
    (["error handled", "exception handled", "caught exception"], "business", "handled_error"),
]

# Patterns of the normalisation of stored messages, in their order, the marks that take their place, and the length that is kept.
STORED_MESSAGE = [
    (r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<UUID>"), (r"\b\d{10,}\b", "<ID>"), (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "<IP>"),
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", "<TS>"), (r"0x[0-9a-fA-F]+", "<HEX>"),
]
STORED_LENGTH = 500

# What is wrong, by an event's category: the first text of which a word is in the message, else the category's own. Fixed values.
CAUSE_TEXTS = {
    "database": ([(["pool", "hikari"], "Database connection pool exhausted"), (["deadlock"], "Database deadlock detected"), (["constraint", "duplicate"], "Database constraint violation")], "Database error"),
    "network": ([(["refused"], "Connection refused - target service may be down"), (["reset"], "Connection reset by peer")], "Network connectivity issue"),
    "timeout": ([(["read"], "Read timeout - downstream service slow"), (["connect"], "Connection timeout - cannot reach target")], "Request timeout"),
    "external": ([(["429", "rate"], "External API rate limit exceeded"), (["503", "unavailable"], "External service unavailable")], "External service issue"),
    "memory": ([], "Out of memory - heap exhausted"),
    "business": ([(["not found", "does not exist"], "Referenced entity not found"), (["validation"], "Input validation failure")], "Business logic error"),
}
