"""Column functions: all return ``Column`` and stay on the JVM, except ``nfc``."""
