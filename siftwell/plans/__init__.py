"""Session, staging and shipping helpers shared by the operators."""
