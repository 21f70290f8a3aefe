"""Column functions shared by all operators; every one stays inside the JVM."""
