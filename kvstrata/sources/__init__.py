"""Tables a store is made of, and views of other tables as logs."""
