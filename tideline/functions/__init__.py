"""tideline subpackage."""
