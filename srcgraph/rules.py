"""Fixed values that must equal the published behaviour: phrases, names, stage rows, limits.

Rows, not branches: operators turn them into expressions or small lookup tables.
"""

from __future__ import annotations

# Query expansion: (groups that must each have a word in the question, words to add).
EXPANSION_RULES = [
    (
        [["validation"], ["error", "parameter"]],
        [
            "request_body_to_args",
            "request_params_to_args",
            "_validate_value_with_model_field",
            "solve_dependencies",
            "field errors parameter processing",
        ],
    ),
    (
        [["await", "async"], ["thread"]],
        ["run_endpoint_function", "is_coroutine", "run_in_threadpool"],
    ),
    ([["returned"], ["response"]], ["serialize_response", "response_content", "Response"]),
    (
        [["depend"], ["nested", "recursive"]],
        ["solve_dependencies", "dependency_cache", "use_cache"],
    ),
    (
        [["endpoint"], ["parameter"]],
        ["get_dependant", "analyze_param", "ModelField", "Dependant"],
    ),
]

# Intents in order of precedence, with the phrases that select them.
INTENT_PHRASES = [
    ("indexing", ["index repository", "re-index", "reindex", "update index"]),
    ("comparison", ["compare", "difference between", "versus", " vs "]),
    ("pattern_analysis", ["design pattern", "patterns", "anti-pattern", "decorator"]),
    ("architecture", ["lifecycle", "architecture", "end-to-end"]),
    (
        "implementation",
        ["implementation", "source code", "docstring", "show code", "explain code"],
    ),
    (
        "dependency_traversal",
        ["inherit", "depends", "dependents", "imports", "calls", "related"],
    ),
    ("entity_lookup", ["what is", "find", "where is", "locate"]),
]
DEFAULT_INTENT = "general"

# Direction of a dependency question: those that match ask what points at the named entity.
INCOMING_WORDS = (
    r"\b(?:what|who|everything that|(?:which|all) \w+(?: that)?)\s+"
    r"(?:depends?\s+on|calls?|imports?|inherits?\s+from)\s+(?!(?:does|do|is|are)\b)"
    r"|\b(?:dependents|callers|importers|subclasses)\s+of\b"
)

# Capitalised words that are not symbols, and the framework name in its usual spelling.
STOP_WORDS = [
    "What", "Where", "How", "Show", "Find", "Explain", "Compare", "Python", "HTTP",
]
FRAMEWORK_NAME = "FastAPI"
REFERENCE_WORDS = r"\b(it|this|that|they|them|the class|the function)\b"

# Concepts in order of precedence: (required intent or None, phrases, symbols).
CONCEPTS = [
    (
        "architecture",
        ["request lifecycle", "lifecycle of a", "end-to-end"],
        [
            "FastAPI.__call__",
            "APIRoute.get_route_handler",
            "get_request_handler",
            "solve_dependencies",
            "run_endpoint_function",
            "serialize_response",
        ],
    ),
    (
        None,
        ["request validation", "validate request"],
        [
            "get_request_handler",
            "solve_dependencies",
            "request_body_to_args",
            "_validate_value_with_model_field",
        ],
    ),
    (
        None,
        ["dependency injection"],
        ["Depends", "get_dependant", "get_parameterless_sub_dependant", "solve_dependencies"],
    ),
    ("pattern_analysis", ["routing"], ["APIRouter"]),
    ("pattern_analysis", ["fastapi", "core", "codebase", "repository"], ["FastAPI"]),
]

# Stage rows: (agent, operation, sequence, reason, agents it depends on) by plan.
STAGES = {
    "index": [("indexer", "index_repository", 0, "Repository indexing requested", "")],
    "lookup": [("graph", "find_entity", 0, "Resolve graph entity", "")],
    "traverse": [
        ("graph", "find_entity", 0, "Resolve graph entity", ""),
        ("graph", "get_dependencies", 1, "Traverse resolved entity dependencies", "graph"),
    ],
    "patterns": [
        ("graph", "find_entity", 0, "Resolve pattern scope", ""),
        ("repository", "verify_source", 1, "Verify revision-pinned pattern source", "graph"),
        ("code_analyst", "find_patterns", 2, "Analyze patterns in resolved source", "repository"),
    ],
    "implementation": [
        ("graph", "find_entity", 0, "Resolve source location", ""),
        ("repository", "verify_source", 1, "Verify revision-pinned implementation source", "graph"),
        ("code_analyst", "explain_implementation", 2, "Analyze resolved source", "repository"),
    ],
    "comparison": [
        ("graph", "find_entity", 0, "Resolve compared entities", ""),
        ("repository", "verify_source", 1, "Verify both revision-pinned sources", "graph"),
        ("code_analyst", "compare_implementations", 2, "Compare resolved source", "repository"),
    ],
    "discovery": [
        (
            "graph",
            "hybrid_search",
            0,
            "Discover revision-scoped source from the complete conceptual question",
            "",
        ),
        ("repository", "verify_source", 1, "Verify hybrid source candidates", "graph"),
        (
            "code_analyst",
            "explain_implementation",
            2,
            "Verify the strongest hybrid candidates against source",
            "repository",
        ),
    ],
    "resolved": [
        ("graph", "find_entity", 0, "Resolve source location", ""),
        ("repository", "verify_source", 1, "Verify revision-pinned source", "graph"),
        ("code_analyst", "explain_implementation", 2, "Analyze resolved source", "repository"),
    ],
    "search": [
        (
            "graph",
            "hybrid_search",
            0,
            "Discover revision-scoped source by meaning and exact terms",
            "",
        ),
        ("repository", "verify_source", 1, "Verify hybrid source candidates", "graph"),
        (
            "code_analyst",
            "explain_implementation",
            2,
            "Analyze the strongest hybrid retrieval candidates",
            "repository",
        ),
    ],
}

# Stages of the request trace in order: (symbol, title, description).
LIFECYCLE_STAGES = [
    (
        "FastAPI.__call__",
        "ASGI entry",
        "`FastAPI.__call__` updates the ASGI scope and delegates into the inherited Starlette "
        "application stack.",
    ),
    (
        "APIRoute.get_route_handler",
        "Matched route handler",
        "After Starlette selects an `APIRoute`, `get_route_handler` creates the handler for that "
        "path operation.",
    ),
    (
        "get_request_handler",
        "Request handling",
        "`get_request_handler` builds the per-request coroutine that coordinates body processing, "
        "dependency resolution, endpoint execution, and response creation.",
    ),
    (
        "solve_dependencies",
        "Dependency resolution",
        "`solve_dependencies` recursively resolves dependency values and manages the "
        "request-scoped dependency cache and exit stacks.",
    ),
    (
        "run_endpoint_function",
        "Endpoint invocation",
        "`run_endpoint_function` invokes an async endpoint directly or sends a synchronous "
        "endpoint to the thread pool.",
    ),
    (
        "serialize_response",
        "Response serialization",
        "`serialize_response` validates and serializes the endpoint result according to the "
        "configured response field and serialization options.",
    ),
]
LIFECYCLE_HEAD = "FastAPI request lifecycle (static, source-grounded trace):"
LIFECYCLE_TAIL = (
    "Together, the bounded trace is: `FastAPI.__call__` → `APIRoute.get_route_handler` → "
    "`get_request_handler` → `solve_dependencies` → endpoint execution → `serialize_response` → "
    "response. Runtime middleware dispatch is inherited from Starlette and is not fully expanded "
    "by this FastAPI-only static trace."
)

# Texts of the design-pattern view.
PATTERN_HEAD = "Source-grounded core pattern observations:"
PATTERN_TAIL = (
    "This is a conservative AST-based view of the selected core module, not an exhaustive claim "
    "about every architectural pattern in the repository."
)
INHERITANCE_TITLE = "1. **Inheritance-based framework extension:** "
INHERITANCE_TEXT = (
    " This lets FastAPI reuse Starlette's ASGI foundation while layering API-specific behavior on "
    "top. "
)
DECORATOR_TITLE = "2. **Decorator-based API evolution:** "
DECORATOR_TEXT = (
    " Decorators attach lifecycle or compatibility policy without changing the wrapped callable's "
    "core role. "
)
ASYNC_TITLE = "3. **Asynchronous orchestration (execution model):** Async entry points include "
ASYNC_TEXT = (
    " This supports non-blocking ASGI request handling; it is an execution style rather than a "
    "Gang-of-Four design pattern."
)
DEPENDENCY_RATIONALE = "Constructs a FastAPI dependency marker."

# Messages and limits of interaction state, indexing and evaluation.
INTERRUPTED_ERROR = "Indexer restarted before the job completed"
PARSE_FAILURE_ERROR = "One or more discovered Python files failed to parse"
CACHE_WARNING = "Response served from revision-scoped cache."
ANALYSIS_VERSION = 2
CACHE_SCHEMA_VERSION = 2
IGNORED_DIRECTORIES = [".git", ".venv", "venv", "__pycache__", "node_modules"]
MAXIMUM_FILE_BYTES = 1_000_000
DEFAULT_PREFERENCES = {"response_detail": "balanced", "code_examples": "when_relevant"}
