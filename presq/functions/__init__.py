"""presq subpackage."""
