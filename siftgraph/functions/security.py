"""What may be asked of the network, and which model a name means, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .domains import scan_target

#: Longest URL that may be asked for.
LONGEST = 4096

# First parts of names of models that run elsewhere.
CLOUD = (
    "openai", "anthropic", "azure", "azure_ai", "bedrock", "vertex_ai", "gemini", "groq", "together_ai", "openrouter", "mistral", "cohere", "deepseek", "xai",
    "perplexity", "fireworks_ai", "replicate", "huggingface", "watsonx", "databricks",
)
DEFAULT_MODEL = "ollama/qwen2.5:7b-instruct"


def url_refusal(url: Column) -> Column:
    """Why a URL may not be asked for (length, scheme, host, credentials, port, target); null where it may."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(url, r"^[^:/?#]*://([^/?#]*)", 1)
    place = F.regexp_replace(authority, r"^.*@", "")
    host = F.regexp_extract(place, r"^(\[[^\]]*\]|[^:\[\]]*)", 1)
    port = F.regexp_extract(place, r"^(?:\[[^\]]*\]|[^:\[\]]*):(.*)$", 1)
    number = F.when(port.rlike("^[0-9]{1,9}$"), port.cast("int"))
    bad_port = (port != "") & (number.isNull() | ~number.between(1, 65535))
    return (
        F.when(F.length(url) > LONGEST, "length")
        .when(~scheme.isin("http", "https"), "scheme")
        .when(host.isin("", "[]"), "host")
        .when(authority.contains("@"), "credentials")
        .when(bad_port, "port")
        .when(~scan_target(host), "target")
    )


def model_id(model: Column) -> Column:
    """The full name of a model: bare tags are local ones, known makers' names stay or get their maker."""
    m = F.trim(model)
    low = F.lower(m)
    maker = F.lower(F.split_part(m, F.lit("/"), F.lit(1)))
    own = m.contains("/") & maker.isin(*CLOUD)
    hosted = low.rlike("^(gpt-|o1|o3|chatgpt-)")
    return (
        F.when(m == "", DEFAULT_MODEL)
        .when(low.startswith("ollama/") | own | hosted, m)
        .when(low.rlike(r"^(claude|anthropic\.)"), F.concat(F.lit("anthropic/"), m))
        .otherwise(F.concat(F.lit("ollama/"), m))
    )


def is_cloud(model: Column) -> Column:
    return ~model_id(model).startswith("ollama/")
