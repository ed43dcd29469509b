from innkeep.sources.bindings import DRIVER_TABLES, bind_tables, load_driver, load_tables  # noqa: F401
