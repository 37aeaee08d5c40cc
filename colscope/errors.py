"""Errors of the library, one base for all."""


class SchemaQualityError(Exception):
    """Base of every error that the library raises on purpose."""


class SourceError(SchemaQualityError):
    """A database or connection could not be used."""


class ConnectionFailed(SourceError):
    """The catalog's database refused the connection."""


class CatalogError(SchemaQualityError):
    """A catalog is missing, inconsistent or lacks a needed block."""


class EncodingError(SchemaQualityError):
    """Texts could not be turned into vectors."""


class ClusteringError(SchemaQualityError):
    """A clustering or reduction method is unknown or cannot run on the data."""


class ConfigError(SchemaQualityError):
    """The configuration is missing or malformed."""
