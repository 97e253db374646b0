"""Configuration of a run: INI files as flat options, and checks of required ones."""

import configparser


def read_config(path: str) -> dict[str, str]:
    """section.option -> value."""
    parser = configparser.ConfigParser(interpolation=None)
    parser.optionxform = str
    with open(path, encoding="utf-8") as f:
        parser.read_file(f)
    return {f"{s}.{o}".lower(): v.strip() for s in parser.sections() for o, v in parser.items(s)}


def missing_options(config: dict[str, str], required: list[str], allowed: dict[str, set[str]] | None = None) -> list[str]:
    """Required options that are absent or empty, and options whose value is not an allowed one."""
    absent = [o for o in required if not config.get(o)]
    return absent + [o for o, values in (allowed or {}).items() if config.get(o) and config[o] not in values]
