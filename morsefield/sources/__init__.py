"""Tables as clouds, images, series and diagrams; readers, writers and input checks."""
