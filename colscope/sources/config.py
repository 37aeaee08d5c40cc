"""Connection settings."""

from __future__ import annotations

from pathlib import Path

from colscope.errors import ConfigError

NEEDED = ("user", "password", "dsn")


def _scalar(text: str) -> str | int | bool | None:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if text.lower() in ("", "null", "~"):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    return int(text) if text.lstrip("-").isdigit() else text


def load_config(path: str) -> dict:
    """Settings from a YAML file of nested mappings; any fault is a ConfigError."""
    file = Path(path)
    if not file.is_file():
        raise ConfigError(f"no configuration at {path}")
    try:
        text = file.read_text(encoding="utf-8")
    except OSError as e:
        raise ConfigError(f"cannot read {path}: {e}") from e
    try:
        import yaml

        try:
            out = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ConfigError(f"{path} is not YAML: {e}") from e
    except ImportError:
        out = _mappings(text, path)
    if not isinstance(out, dict) or not out:
        raise ConfigError(f"{path} holds no settings")
    return out


def _mappings(text: str, path: str) -> dict:
    """Nested mappings of scalars, for where no YAML library is installed."""
    top: dict = {}
    levels: list[tuple[int, dict]] = [(-1, top)]
    for number, line in enumerate(text.splitlines(), 1):
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        depth = len(bare) - len(bare.lstrip())
        key, colon, value = bare.strip().partition(":")
        if not colon or "\t" in bare[:depth]:
            raise ConfigError(f"{path}, line {number}: not a setting")
        while levels[-1][0] >= depth:
            levels.pop()
        if value.strip():
            levels[-1][1][key.strip()] = _scalar(value)
        else:
            levels[-1][1][key.strip()] = below = {}
            levels.append((depth, below))
    return top


def jdbc_options(config: dict) -> dict[str, str]:
    """Options of Spark's JDBC reader from the `database` settings."""
    database = config.get("database") or {}
    missing = [k for k in NEEDED if not database.get(k)]
    if missing:
        raise ConfigError(f"database settings are missing: {', '.join(missing)}")
    return {"url": database.get("url") or f"jdbc:oracle:thin:@{database['dsn']}", "user": str(database["user"]), "password": str(database["password"]), "driver": database.get("driver", "oracle.jdbc.OracleDriver")}
